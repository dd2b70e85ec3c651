"""From reads to canonical k-mers.

Two forms with one meaning.  ``kmers`` is a chain of expressions and serves
every k; segments are first cut into pieces with k - 1 bases in common, since
substr from a far offset is linear.  ``kmer_codes`` packs k-mers of up to 31
bases into BIGINTs, column-wise over a batch, and adds up equal ones before
they leave the task; it is what counting uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import revcomp, segments

PACKED_K = 31
_CODES = np.full(256, 4, np.uint8)
for _code, _base in enumerate(b"ACGT"):
    _CODES[_base] = _CODES[_base | 0x20] = _code
for _skip in b"\r\n":
    _CODES[_skip] = 5


def pieces(reads: DataFrame, k: int, piece_len: int = 1000, column: str = "seq") -> DataFrame:
    """One column `piece`: valid runs of at least k bases, cut so that every window of k lies in one piece."""
    size = max(piece_len, 2 * k)
    runs = reads.select(F.explode(segments(column)).alias("run")).where(F.length("run") >= k)
    starts = F.sequence(F.lit(0), F.length("run") - k, F.lit(size - k + 1))
    return runs.select(F.explode(F.transform(starts, lambda s: F.substring(F.col("run"), s + 1, F.lit(size)))).alias("piece"))


def kmers(reads: DataFrame, k: int, piece_len: int = 1000, column: str = "seq") -> DataFrame:
    """One column `kmer`, a row per window: the canonical k-mer as a string."""
    cut = pieces(reads, k, piece_len, column).select("piece", revcomp("piece").alias("back"), F.length("piece").alias("n"))
    at = cut.select("piece", "back", "n", F.explode(F.sequence(F.lit(1), F.col("n") - k + 1)).alias("i"))
    forward = F.substring(F.col("piece"), F.col("i"), F.lit(k))
    return at.select(F.least(forward, F.substring(F.col("back"), F.col("n") - k + 2 - F.col("i"), F.lit(k))).alias("kmer"))


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Each k codes as one number, two bits a code, by doubling."""
    out, width, word, span = None, 0, codes.astype(np.int64), 1
    rest = k
    while rest:
        if rest & 1:
            out = word if out is None else (out[: len(word) - width] << (2 * span)) | word[width:]
            width += span
        rest >>= 1
        if rest:
            word = (word[:-span] << (2 * span)) | word[span:]
            span *= 2
    return out[: len(codes) - k + 1]


def packed_kmers(data: np.ndarray, k: int) -> np.ndarray:
    """Canonical codes of all windows in bytes; bytes that are no base end a run, line breaks are skipped."""
    codes = _CODES[data]
    codes = codes[codes != 5]
    if len(codes) < k:
        return np.zeros(0, np.int64)
    bad = np.cumsum(np.r_[0, codes == 4])
    good = bad[k:] == bad[:-k]
    codes = codes & 3
    forward = _windows(codes, k)
    backward = _windows(3 - codes[::-1], k)[::-1]
    return np.minimum(forward, backward)[good]


def _count_batches(k: int, flush: int = 1 << 22):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).drop_null()
            start = 0
            sizes = np.cumsum([len(t.as_buffer()) for t in texts]) if len(texts) else []
            while start < len(texts):
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + flush, "right")))
                joined = b"|".join(t.as_py() for t in texts.slice(start, stop - start))  # "|" is no base
                found, n = np.unique(packed_kmers(np.frombuffer(joined, np.uint8), k), return_counts=True)
                start = stop
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["code", "n"])

    return run


def kmer_codes(reads: DataFrame, k: int, column: str = "seq") -> DataFrame:
    """code (packed canonical k-mer), n: counts per batch of reads, to be summed.  k of at most 31."""
    if not 1 <= k <= PACKED_K:
        raise ValueError(f"k must be from 1 to {PACKED_K}")
    return reads.select(F.col(column).cast("string")).mapInArrow(_count_batches(k), "code long, n long")
