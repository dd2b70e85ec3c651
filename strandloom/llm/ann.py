"""Approximate nearest neighbours: probed lists and an adaptive scan of dimensions.

Vectors are dealt to the lists of a coarse quantiser, and a query looks at its
nearest lists.  Within a list the vectors, turned by a random rotation, lie in
blocks of columns.  After each block a hypothesis test asks whether the partial
distance, scaled to all dimensions, can still be below the k-th best so far; a
candidate that fails it is left.  Survivors are measured on the original
vectors in double precision.  The nearest list is searched first; its k-th best
distance goes along to the other lists, where the test rules from the first
candidate on.

The quantiser is fitted on a bounded sample; every vector is indexed.  Equal
vectors are one entry with their k + 1 smallest ids, so a vector that a third of
all rows repeat is no hot spot, and lists and their queries are dealt out in
tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def rotation(dimensions: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def quantiser(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty list takes the point farthest from its centre."""
    lists = max(1, min(lists, len(sample)))
    centres = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        nearest, gap = assign(sample, centres)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=lists)
        np.add.at(sums, nearest, sample)
        full = counts > 0
        centres[full] = sums[full] / counts[full][:, None]
        for at, far in zip(np.flatnonzero(~full), np.argsort(-gap)):
            centres[at] = sample[far]
    return centres


def assign(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gaps = _gaps(vectors, centres)
    nearest = gaps.argmin(1)
    return nearest, gaps[np.arange(len(vectors)), nearest]


def _gaps(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1)


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, trials: int = 200) -> int:
    """The fewest lists to probe with which `trials` rows of the sample find that share of
    their k nearest.  The whole table is denser, and so its neighbours nearer, than the sample."""
    lists, _ = assign(sample, centres)
    asked = np.arange(0, len(sample), max(1, len(sample) // trials))
    needed = []
    for at in asked.tolist():
        gaps = ((sample - sample[at]) ** 2).sum(1)
        gaps[at] = np.inf
        near = np.argsort(gaps, kind="stable")[: min(k, len(sample) - 1)]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(_gaps(sample[at : at + 1], centres)[0], kind="stable")] = np.arange(len(centres))
        needed += (place[lists[near]] + 1).tolist()
    needed.sort()
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)))] if needed else 1


def scan(query: np.ndarray, turned: np.ndarray, limit: float, block: int, epsilon: float) -> np.ndarray:
    """Rows that the adaptive scan doesn't leave.  turned: rotated vectors, query rotated alike, limit the k-th best square.

    The square over d of D dimensions, scaled by D / d, lies below the true one by
    a share of more than epsilon / sqrt(d) only with small probability.
    """
    size = turned.shape[1]
    rows, sums, at = np.arange(len(turned)), np.zeros(len(turned)), 0
    while at < size and len(rows):
        part = turned[rows, at : at + block] - query[at : at + block]
        sums = sums + (part * part).sum(1)
        at += block
        slack = (1 + epsilon / math.sqrt(at)) ** 2 if at < size else 1.0 + 1e-9
        keep = sums <= limit * (min(at, size) / size) * slack
        rows, sums = rows[keep], sums[keep]
    return rows


def search_tile(queries: np.ndarray, query_ids: np.ndarray, limits: np.ndarray, vectors: np.ndarray, ids: list[list[int]], k: int, turn: np.ndarray, block: int, epsilon: float, step: int = 512, seen: dict | None = None) -> list[tuple[int, int, float]]:
    """(query id, vec_id, distance) of the k nearest rows of a tile for each query, but not the query's own
    row.  limits: the k-th best distance that each query knows already, or infinity; what is farther
    is left out.  seen counts candidates, and those of them that were measured whole."""
    turned, out = vectors @ turn, []
    seen = {} if seen is None else seen
    for query, own, query_id, limit in zip(queries, queries @ turn, query_ids.tolist(), np.square(limits).tolist()):
        best: list[tuple[float, int]] = []
        at = 0
        while at < len(vectors):
            # A few rows give the first limit; from then on the scan tests every candidate.
            if limit < math.inf:
                rows, stop = at + scan(own, turned[at : at + step], limit, block, epsilon), at + step
            else:
                stop = min(at + 2 * (k + 1), len(vectors))
                rows = np.arange(at, stop)
            at = stop
            seen["whole"] = seen.get("whole", 0) + len(rows)
            if not len(rows):
                continue
            gaps = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
            # An entry stands for one candidate at least, but the query's own may be its only one.
            if len(rows) > k + 1:
                part = np.argpartition(gaps, k)[: k + 1]
                near = gaps <= gaps[part].max()
                rows, gaps = rows[near], gaps[near]
            best += [(gap, i) for gap, row in zip(gaps.tolist(), rows.tolist()) for i in ids[row] if i != query_id]
            best = sorted(best)[:k]
            if len(best) == k:
                limit = min(limit, best[-1][0] ** 2)
        seen["all"] = seen.get("all", 0) + len(vectors)
        out += [(query_id, i, gap) for gap, i in best]
    return out


def _list_of(centres: np.ndarray, name: str, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column(1).to_pylist(), np.float64)
            gaps = _gaps(vectors, centres)
            n = min(probes, len(centres))
            near = np.argsort(gaps, axis=1, kind="stable")[:, :n]
            lists = pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    return run


def _tiles(k: int, dimensions: int, block: int, epsilon: float):
    turn = rotation(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile, a tile's vectors before its queries."""
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            kinds = np.concatenate([x[0] for x in held])
            if kinds.all() or not kinds.any():
                return
            vectors, asked = np.concatenate([x[1] for x in held]), kinds == 1
            ids = [i for x in held for i in x[2].to_pylist() if i is not None]
            query_ids, limits = (np.concatenate([x[c] for x in held])[asked] for c in (3, 4))
            found = search_tile(vectors[asked], query_ids.astype(np.int64), limits, vectors[~asked], ids, k, turn, block, epsilon)
            if found:
                q, v, gap = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(gap, pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if held and tuple(keys[start]) != now:
                    yield from close()
                    held = []
                now = tuple(keys[start])
                kind, vector, ids, query, limit = (c.slice(start, stop - start) for c in batch.columns[3:])
                held.append((kind.to_numpy(), vector.flatten().to_numpy().reshape(-1, dimensions), ids, query.fill_null(0).to_numpy(), limit.fill_null(0).to_numpy()))
        if held:
            yield from close()

    return run


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vector (doubles): rows whose vector is there, finite in all parts and not zero."""
    vector = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0.0))


def nearest(rows: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, probes: int | None = None, recall: float = 0.95, list_rows: int = 512, most_lists: int = 4096, sample_rows: int = 20_000, block: int = 16, epsilon: float = 2.1, tile_rows: int = 4096, tile_queries: int = 512, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query, by Euclidean distance, ties to the smaller vec_id.

    queries: ids (vec_id) of the query rows; by default those divisible by
    `every`.  Null, zero and non-finite vectors and null ids take no part, and
    where lengths differ only the most common one does.  With fewer candidates
    than k all are returned.  An empty table gives an empty result.
    sample_rows bounds the rows that the quantiser is fitted on, and on which
    the number of probed lists is chosen for the given recall, unless `probes`
    fixes it.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = usable(rows, id_column, vector_column)
    sizes = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    dimensions = sizes["size"]
    good = good.where(F.size("vector") == dimensions)
    wanted = F.col("vec_id") % every == 0
    if queries is not None:
        ids = queries.select(F.col(id_column).cast("long").alias("vec_id")).distinct()
        asked = good.join(ids, "vec_id", "left_semi")
    else:
        asked = good.where(wanted)
    # Equal vectors are one entry, with the ids that can be among a query's k nearest.
    # Ranks are limited before the shuffle.
    by_vector = W.partitionBy("vector").orderBy("vec_id")
    entries = good.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    entries = common.stored(entries.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    count = entries.count()
    order = F.xxhash64("vector")
    sample = np.array([r[0] for r in entries.select("vector").orderBy(order).limit(sample_rows).collect()], np.float64)
    lists = int(max(1, min(most_lists, count // list_rows + 1, len(sample) // 16 + 1)))
    centres = quantiser(sample, lists)
    probes = probes or probes_for(sample, centres, k, recall)

    vectors = entries.select("ids", "vector").mapInArrow(_list_of(centres, "lists", 1), "ids array<long>, vector array<double>, lists array<int>")
    vectors = common.stored(vectors.select("ids", "vector", F.col("lists")[0].alias("list")), "lists")
    asked = asked.select("vec_id", "vector").mapInArrow(_list_of(centres, "lists", probes), "vec_id long, vector array<double>, lists array<int>")
    asked = asked.select("vec_id", "vector", F.posexplode("lists").alias("turn", "list"))
    asked = common.stored(asked, "queries")
    count_up = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def searched(wanted: DataFrame) -> DataFrame:
        """wanted: vec_id, vector, list, limit of queries."""
        # At most one row per list: small and bounded by most_lists.
        parts = vectors.groupBy("list").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("vector_parts"))
        parts = F.broadcast(parts.join(wanted.groupBy("list").agg(F.ceil(F.count("*") / tile_queries).cast("int").alias("query_parts")), "list"))
        left = vectors.join(parts, "list").withColumn("a", F.pmod(F.xxhash64("vector"), F.col("vector_parts")).cast("int")).withColumn("b", F.explode(count_up("query_parts")))
        left = left.select("list", "a", "b", F.lit(0).alias("kind"), "vector", "ids", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("limit"))
        right = wanted.join(parts, "list").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("query_parts")).cast("int")).withColumn("a", F.explode(count_up("vector_parts")))
        right = right.select("list", "a", "b", F.lit(1).alias("kind"), "vector", F.lit(None).cast("array<long>").alias("ids"), F.col("vec_id").alias("query_id"), "limit")
        tiles = left.union(right).repartition("list", "a", "b").sortWithinPartitions("list", "a", "b", "kind")
        return tiles.mapInArrow(_tiles(k, dimensions, block, epsilon), "query_id long, vec_id long, score double")

    unknown = F.lit(float("inf"))
    found = common.stored(searched(asked.where("turn = 0").withColumn("limit", unknown)), "nearest-list")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    if probes > 1:
        limits = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
        others = asked.where("turn > 0").join(limits, "vec_id", "left").withColumn("limit", F.coalesce("limit", unknown))
        found = found.union(searched(others))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
