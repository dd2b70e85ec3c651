"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each end to the first (smallest) of its component, in place of all links."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(ends))
            return ends[label[moved]], ends[moved]
        label = new


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, as stars."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if held:
        low, high = star(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], ["hi", "lo"])


def connected_components(edges: DataFrame, most_rounds: int = 60, few: int = 500_000) -> DataFrame:
    """edges: columns a, b (long).  Returns (node, root), root the smallest node that is reachable; nodes without an edge are absent.

    Alternating large-star and small-star rounds: every round is a few
    shuffles over rows of two longs, minima are combined before the shuffle
    (a node with very many neighbours is no burden), and the number of rounds
    grows with the logarithm of the longest path.  Each round is written to the
    shared folder, so a lost executor repeats one round at most.  Once at most
    `few` edges are left a single task does the rest.
    """
    ordered = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = common.stored(edges.where("a <> b").select(*ordered).distinct(), "edges")
    for _ in range(most_rounds):
        if now.count() <= few:
            now = common.stored(now.coalesce(1).mapInArrow(_starred, "hi long, lo long"), "edges")
            return _labelled(now)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        then = common.stored(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        settled = now.count() == then.count() and now.exceptAll(then).isEmpty()
        common.drop_stored(now)
        now = then
        if settled:
            return _labelled(now)
    raise RuntimeError("components did not settle")


def _labelled(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(stars.select("lo", "lo").distinct())
