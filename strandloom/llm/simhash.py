"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint of 64 bits is made per document; documents link where at most
``radius`` bits differ, and the components of that graph are the groups.

The index is a tree over fingerprints in Gray order, where neighbours differ in
few bits: runs of them form nodes that keep the bits all of them share, runs of
nodes form nodes again, and a pattern that children share is factored out into
their parent.  A search goes down from the root, adds up the differing bits from
node to node and leaves a whole group as soon as they exceed the radius.

Over the cluster the Gray order is cut into ranges.  There are ``radius + 1``
such orders, in each of which another of as many blocks of bits stands first.
Two fingerprints within the radius agree on a whole block, and the first bits
of a code fix those of its Gray rank, so in the order that this block leads both
lie in one range: no pair is lost, and a fingerprint is dealt out radius + 1
times, whatever their number.

Only distinct fingerprints enter (copies are one row, however many), a range
with more than ``node_rows`` of them is dealt out as pairs of parts, and a task
reports a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

SEED = 42
_MAX = (1 << 64) - 1


def fingerprint(text: str | bytes | None, words_per_shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text (in UTF-8, if bytes); zero where it has no word."""
    text = text or b""
    words = (text.encode() if isinstance(text, str) else text).lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, texts = batch.columns
            found = [fingerprint(t.as_py(), words_per_shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(found, np.uint64).view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the sequence of reflected Gray codes."""
    x = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """A tree over fingerprints in Gray order.

    Each node keeps the bits that all below it share, less those its parent
    keeps already: a pattern under a mask.  `checked` counts the nodes and
    fingerprints that searches looked at, `pruned` the fingerprints that they
    left unseen, in whole groups.
    """

    def __init__(self, prints: np.ndarray, fanout: int = 4):
        self.prints, self.fanout = prints, fanout
        self.checked = self.pruned = 0
        level = [(prints, np.full(len(prints), _MAX, np.uint64))]
        while len(level[-1][0]) > 1:
            bits, mask = level[-1]
            heads = np.arange(0, len(bits), fanout)
            of = np.arange(len(bits)) // fanout
            differ = np.bitwise_or.reduceat(bits ^ bits[heads][of], heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~differ
            level.append((bits[heads] & shared, shared))
        self.levels = []
        for depth, (bits, mask) in enumerate(level):
            above = level[depth + 1][1][np.arange(len(bits)) // fanout] if depth + 1 < len(level) else np.uint64(0)
            own = mask & ~above
            self.levels.append((bits & own, own))

    def within(self, asked: np.ndarray, radius: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in asked, place in prints) that differ in at most radius bits.
        after: for each one asked, the place behind which its partners have to stand."""
        query, at, so_far = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.uint8)
        size = len(self.prints)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, own = self.levels[depth]
            span = self.fanout**depth
            if after is not None:
                later = np.minimum((at + 1) * span, size) - 1 > after[query]
                query, at, so_far = query[later], at[later], so_far[later]
            so_far = so_far + np.bitwise_count((bits[at] ^ asked[query]) & own[at])
            keep = so_far <= radius
            self.checked += len(keep)
            if depth:
                gone = at[~keep]
                self.pruned += int((np.minimum((gone + 1) * span, size) - gone * span).sum())
            query, at, so_far = query[keep], at[keep], so_far[keep]
            if depth:
                query, so_far = np.repeat(query, self.fanout), np.repeat(so_far, self.fanout)
                at = (at[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                there = at < len(self.levels[depth - 1][0])
                query, at, so_far = query[there], at[there], so_far[there]
        return query, at


def forest(prints: np.ndarray, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that connect what the graph of all links within prints, in Gray order, connects."""
    index = GrayIndex(prints)
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(prints), step):
        places = np.arange(start, min(start + step, len(prints)))
        a, b = index.within(prints[places], radius, places)
        if len(a):
            left, right = components.star(np.concatenate([left, places[a]]), np.concatenate([right, b]))
    return left, right


def _links(radius: int, flush_rows: int = 1 << 16):
    """Rows come sorted by range (kind, key, part, other) and Gray rank; whole ranges are worked on together."""

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        *node, prints = columns
        change = np.zeros(len(prints), bool)
        for c in node:
            change[1:] |= c[1:] != c[:-1]
        edges = np.r_[0, np.flatnonzero(change), len(prints)]
        prints, kinds, left, right = prints.view(np.uint64), [], [], []
        for start, stop in zip(edges, edges[1:]):
            part = prints[start:stop]
            a, b = forest(part, radius)
            kinds.append(np.full(len(a), node[0][start], np.int32))
            left.append(part[a])
            right.append(part[b])
        kinds, a, b = map(np.concatenate, (kinds, left, right))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in common.whole_runs(batches, 4, flush_rows):
            yield links(columns)
        common.release_memory()

    return run


def _turned(column: Column, bits: int) -> Column:
    """The 64 bits turned left."""
    return F.shiftleft(column, bits).bitwiseOR(F.shiftrightunsigned(column, 64 - bits)) if bits else column


def gray_ranges(n: int, radius: int, range_rows: int) -> list[tuple[int, int]]:
    """(turn, bits) of each order: by how much a fingerprint is turned so that the order's block
    stands first, and how many first bits make a range, so that n fingerprints would give about range_rows each."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    wanted = max(0, math.ceil(math.log2(max(n, 1) / range_rows)))
    return [((64 - high) % 64, min(high - low, wanted)) for low, high in zip(edges, edges[1:])]


def near_links(prints: DataFrame, radius: int = 3, node_rows: int = 8192, range_rows: int = 1024) -> DataFrame:
    """prints: one column fp (long) of distinct fingerprints.  Returns links a, b that
    connect exactly what the links within the radius connect."""
    orders = gray_ranges(prints.count(), radius, range_rows)
    turned = F.array(*(F.struct(F.lit(kind).alias("kind"), _turned(F.col("fp"), turn).alias("code"), F.lit(64 - bits).alias("rest")) for kind, (turn, bits) in enumerate(orders)))
    nodes = prints.select("fp", F.inline(turned))
    # The first bits of the code, in two steps, as a shift by 64 would be none.
    key = F.call_function("shiftrightunsigned", F.shiftrightunsigned("code", 1), F.col("rest") - 1)
    nodes = nodes.select("kind", key.alias("key"), "code")
    crowded = nodes.groupBy("kind", "key").count().where(F.col("count") > node_rows)
    crowded = crowded.select("kind", "key", F.ceil(F.col("count") / node_rows).cast("int").alias("parts"))
    nodes = nodes.join(crowded, ["kind", "key"], "left")
    # Every two parts of a crowded range meet in one task.
    mine = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != mine)
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("other")))).otherwise(
        F.transform(others, lambda j: F.struct(F.least(mine, j).alias("part"), F.greatest(mine, j).alias("other")))
    )
    nodes = nodes.withColumn("tile", F.explode(pairs)).select("kind", "key", "tile.part", "tile.other", "code")
    rank = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
        nodes = nodes.withColumn("rank", rank)
        rank = F.col("rank")
    # Ranks are unsigned: the sign bit is turned over for the order.
    dealt = nodes.withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63)))).repartition("kind", "key", "part", "other")
    dealt = dealt.sortWithinPartitions("kind", "key", "part", "other", "rank").drop("rank")
    turns = F.element_at(F.array(*(F.lit((64 - turn) % 64) for turn, _ in orders)), F.col("kind") + 1)
    back = lambda c: F.call_function("shiftleft", c, turns).bitwiseOR(F.call_function("shiftrightunsigned", c, F.pmod(64 - turns, F.lit(64))))
    found = dealt.mapInArrow(_links(radius), "kind int, a long, b long")
    return found.select(back(F.col("a")).alias("a"), back(F.col("b")).alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3, id_column: str = "doc_id", text_column: str = "text", node_rows: int = 8192, keep: list[Column] | None = None) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id,
    group_print (the fingerprint that names the group), and the columns of keep.

    component_id is the smallest doc_id of the group, the document's own where
    it is alone.  A null or blank text has fingerprint zero and links like any
    other.  Repeated doc_ids keep their rows; a null doc_id stays null and
    never names a group (a group of such rows alone has a null component_id).
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *(keep or []), F.col(text_column).cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    prints = common.stored(rows.mapInArrow(_fingerprints(words_per_shingle), schema), "prints")
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-prints")
    roots = components.connected_components(near_links(distinct.select("fp"), radius, node_rows))
    roots = common.stored(roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "first_id"), "roots")
    least = roots.groupBy("root").agg(F.min("first_id").alias("least"))
    groups = roots.join(least, "root").select("fp", "root", "least")
    groups = distinct.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first_id").alias("component_id"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return prints.join(groups, "fp").select("doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("group_print"), *schema.names[1:-1])
