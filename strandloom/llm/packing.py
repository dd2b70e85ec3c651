"""Best-fit packing of token pieces into sequences of a fixed capacity.

Which pieces share a sequence depends on their lengths alone, and there are at
most ``capacity`` different lengths.  So the search works on the histogram of
lengths (2,048 counts at most, however large the corpus), on the driver, and
yields *patterns*: a multiset of lengths and how many sequences are filled so.
The pieces of one length are then numbered in parallel, and each number falls
into one pattern.  Copies of one document, or a third of all rows of one
length, are no more than one large count and are numbered in salted groups.

The search is bin completion by branch and bound: around the largest remaining
length, fillings by any number of lengths are tried in order of their waste, the
totals that the remaining lengths can make telling which there are; a branch ends
when its waste so far can't beat the incumbent, which starts as best fit
decreasing.  If the incumbent meets the lower bound, it is optimal and no
search takes place.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, encoder

Pattern = tuple[tuple[int, int], ...]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The number of sequences that no packing can go below (the bound L2 of Martello and Toth)."""
    n, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for length, count in counts.items():
        n[length], total[length] = count, length * count
    n, total = np.cumsum(n), np.cumsum(total)  # of lengths up to the index
    half, best = capacity // 2, -(-int(total[capacity]) // capacity)
    for least in range(half + 1):
        large = int(n[capacity] - n[capacity - least])
        middle, middle_sum = (int(x[capacity - least] - x[half]) for x in (n, total))
        small = int(total[half] - (total[least - 1] if least else 0))
        best = max(best, large + middle + max(0, -(-(small - (middle * capacity - middle_sum)) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing.  Sequences filled alike are held as one group, so
    each length opens at most a few groups and the work doesn't grow with the counts."""
    free: list[dict[Pattern, int]] = [{} for _ in range(capacity + 1)]

    def put(pattern: Pattern, left: int, times: int) -> None:
        free[left][pattern] = free[left].get(pattern, 0) + times

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        n, left = counts[length], length
        while n and left <= capacity:
            if not free[left]:
                left += 1
                continue
            each = left // length
            pattern, times = free[left].popitem()
            full = min(times, n // each)
            if full:
                put((*pattern, (length, each)), left - each * length, full)
                n -= full * each
            rest = times - full
            if rest and n:  # fewer than `each` are left
                put((*pattern, (length, n)), left - n * length, 1)
                n, rest = 0, rest - 1
            if rest:
                put(pattern, left, rest)
        each = capacity // length
        if n // each:
            put(((length, each),), capacity - each * length, n // each)
        if n % each:
            put(((length, n % each),), capacity - n % each * length, 1)
    return [x for group in free for x in group.items()]


def dominates(better: tuple[int, ...], worse: tuple[int, ...]) -> bool:
    """Whether the lengths of `worse` can be dealt out so that each share fits one length of `better`."""
    room = list(better)

    def deal(at: int) -> bool:
        if at == len(worse):
            return True
        for i, x in enumerate(room):
            if x >= worse[at]:
                room[i] -= worse[at]
                if deal(at + 1):
                    return True
                room[i] += worse[at]
        return False

    return len(worse) >= len(better) and deal(0)


def fillings(counts: np.ndarray, left: int, waste: int) -> Iterator[Pattern]:
    """All fillings of `left` that waste at most `waste`, by any number of lengths, least
    waste first and large lengths first; such that leave room for one more are left out.
    counts: by length, what remains."""
    there = np.flatnonzero(counts[: left + 1])
    there = there[there > 0][::-1].tolist()
    most = [min(int(counts[x]), left // x) for x in there]
    # sums[i]: the totals that the lengths from i on can make, as bits.
    sums, full = [1] * (len(there) + 1), (2 << left) - 1
    for i in range(len(there) - 1, -1, -1):
        made, k, step = sums[i + 1], most[i], 1
        while k:
            step = min(step, k)
            made |= made << step * there[i]
            k -= step
            step *= 2
        sums[i] = made & full

    def exact(want: int, at: int) -> Iterator[Pattern]:
        if not want:
            yield ()
            return
        for i in range(at, len(there)):
            if not sums[i] >> want & 1:
                return  # nor can the lengths further on
            x = there[i]
            for k in range(min(most[i], want // x), 0, -1):
                if sums[i + 1] >> want - k * x & 1:
                    for rest in exact(want - k * x, i + 1):
                        yield ((x, k), *rest)

    for gap in range(min(waste, left) + 1):
        # Of a length that is left over in every filling, one more would fit.
        if gap and there and there[-1] <= gap and counts[there[-1]] > (left - gap) // there[-1]:
            return
        if sums[0] >> left - gap & 1:
            small = [x for x in there if x <= gap]
            for filling in exact(left - gap, 0):
                used = dict(filling)
                if all(used.get(x, 0) >= counts[x] for x in small):
                    yield filling


#: So many branches at the end of the search path keep their place; those above look it up again.
LIVE = 16


class Branch:
    """The choices around the largest length, and how far they are tried: patterns and how often at most,
    each as often as it can be, then each once, so that together with the choices below any number of
    times is tried."""

    def __init__(self, top: int, now: np.ndarray, capacity: int, waste: int):
        self.top, self.now, self.room, self.waste = top, now, capacity - top, waste
        self.tried, self.open = 0, self._all()

    def _all(self) -> Iterator[tuple[Pattern, int]]:
        for most in (int(self.now.sum()) + 1, 1):
            for filling in fillings(self.now, self.room, self.waste):
                more = dict(filling)
                pattern = ((self.top, more.pop(self.top, 0) + 1), *more.items())
                if most > 1 or all(self.now[x] + (x == self.top) >= 2 * k for x, k in pattern):
                    yield pattern, most

    def next(self) -> tuple[Pattern, int] | None:
        if self.open is None:
            self.open = itertools.islice(self._all(), self.tried, None)
        self.tried += 1
        return next(self.open, None)

    def rest(self) -> None:
        """Keep the count alone: the tables of an open search are large."""
        self.open = None


def complete_bins(counts: dict[int, int], capacity: int, incumbent: list[tuple[Pattern, int]], nodes: int = 2_000) -> list[tuple[Pattern, int]]:
    """Bin completion.  `nodes` bounds the search; a packing of everything is kept at all times."""
    best, used = incumbent, sum(k for _, k in incumbent)
    bound = lower_bound(counts, capacity)
    total = sum(length * k for length, k in counts.items())
    left = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        left[length] = k
    path: list[tuple[Pattern, int, int]] = []  # what is filled, how often, the waste
    stack: list[Branch] = []
    wasted = 0

    def choices() -> "Branch":
        top = int(np.flatnonzero(left)[-1])
        now = left.copy()
        now[top] -= 1
        return Branch(top, now, capacity, min(capacity - top, (used - 1) * capacity - total - wasted))

    if used > bound and left.any():
        stack.append(choices())
    while stack and nodes > 0 and used > bound:
        choice = stack[-1].next() if stack[-1] else None
        if choice is None:
            stack.pop()
            if path:
                pattern, times, waste = path.pop()
                wasted -= waste
                for length, each in pattern:
                    left[length] += each * times
            continue
        nodes -= 1
        pattern, most = choice
        times = min(most, *(int(left[length]) // each for length, each in pattern))
        spare, allowed = capacity - sum(length * each for length, each in pattern), (used - 1) * capacity - total - wasted
        if spare:
            times = min(times, allowed // spare) if allowed >= spare else 0
        if times <= 0:
            continue
        for length, each in pattern:
            left[length] -= each * times
        wasted += spare * times
        path.append((pattern, times, spare * times))
        if not left.any():
            best, used = [(p, k) for p, k, _ in path], sum(k for _, k, _ in path)
            stack.append(None)
        else:
            stack.append(choices())
            if len(stack) > LIVE and stack[-LIVE - 1]:
                stack[-LIVE - 1].rest()
    return best


def plan(counts: dict[int, int], capacity: int, nodes: int = 2_000) -> list[tuple[Pattern, int]]:
    """Patterns that hold exactly the given counts, in as few sequences as the search finds."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    return complete_bins(counts, capacity, best_fit(counts, capacity), nodes)


def places(patterns: list[tuple[Pattern, int]], counts: dict[int, int]) -> tuple[dict[int, int], dict[str, np.ndarray]]:
    """For each length the first of its numbers, and ranges of numbers with the sequence and offset they lie at."""
    first, at = {}, 0
    for length in sorted(counts):
        first[length] = at
        at += counts[length]
    after, rows, sequence = dict(first), [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((after[length], sequence, each, offset))
            after[length] += each * times
            offset += each * length
        sequence += times
    rows.sort()
    columns = np.array(rows or [(0, 0, 1, 0)], dtype=np.int64).T
    return first, dict(zip(("number", "sequence", "each", "offset"), columns))


def _pieces(tokenizer: str, capacity: int, with_ids: bool):
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder.opened(tokenizer).encode_many
        for batch in batches:
            for keys, texts in encoder.slices(batch.column(0), batch.column(1)):
                rows = []
                for key, ids in zip(keys, encode(texts)):
                    ids += encoder.END
                    n, start = len(ids) // 4, 0
                    size = n % capacity or capacity  # the first piece takes what full ones leave
                    piece = 0
                    while start < n:
                        part = ids[4 * start : 4 * (start + size)]
                        rows.append((key, piece, start, size, zlib.crc32(part), *[part] * with_ids))
                        start, piece, size = start + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _placed(first: dict[int, int], table: dict[str, np.ndarray], lengths_at: int, number_at: int):
    begin = np.zeros(max(first, default=0) + 1, np.int64)
    for length, at in first.items():
        begin[length] = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(lengths_at).to_numpy()
            number = begin[length] + batch.column(number_at).to_numpy()
            row = np.searchsorted(table["number"], number, "right") - 1
            since = number - table["number"][row]
            sequence = table["sequence"][row] + since // table["each"][row]
            offset = table["offset"][row] + since % table["each"][row] * length
            names = [n for i, n in enumerate(batch.schema.names) if i != number_at]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != number_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, nodes: int = 2_000, group_rows: int = 50_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, binary u32, on request).

    A null text counts as empty and gives one piece that holds the end id.
    Only documents longer than the capacity are cut.  Repeated and null
    doc_ids keep all their rows.  An empty table gives an empty result.
    group_rows: rows of a length that are numbered together in one task.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = PIECES + ", ids binary" * with_ids
    pieces = common.stored(rows.mapInArrow(_pieces(tokenizer or encoder.default_tokenizer(), capacity, with_ids), schema), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max(64, -(-sum(counts.values()) // group_rows))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = offsets.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = pieces.withColumn("rank", F.row_number().over(order).cast("long")).join(offsets, ["length", "salt"])
    names = [x.split()[0] for x in schema.split(", ")]
    numbered = numbered.select(*names, (F.col("earlier") + F.col("rank") - 1).alias("number"))
    first, table = places(plan(counts, capacity, nodes), counts)
    return numbered.mapInArrow(_placed(first, table, names.index("length"), len(names)), schema + ", sequence_id long, offset long")
