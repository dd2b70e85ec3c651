"""The three commands as whole plans: count, histo, dump."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import dump as dump_lines
from ..operators import exported, histogram, raw_counts, statistics
from ..params import CountParams
from ..sources import read_reads, read_result, write_dump, write_histogram, write_result


@dataclass
class Counted:
    """raw: all counts; result: filtered and cut.  Both are lazy and share one scan if raw is cached."""

    raw: DataFrame
    params: CountParams

    @property
    def result(self) -> DataFrame:
        return exported(self.raw, self.params)

    @property
    def stats(self) -> DataFrame:
        return statistics(self.raw, self.params)


#: Rows of a batch of reads that Spark hands to Python, so that pieces of 64 KiB make 32 MiB at most.
BATCH_ROWS = 512
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def count(spark: SparkSession, paths: str | list[str], params: CountParams, format: str = "fasta", compression: str = "auto", mode: str = "compat", out: str | None = None) -> Counted:
    """Count the k-mers of files; with out, also write the binary result.

    Lowers the session's Arrow batches to BATCH_ROWS rows where pieces are long.
    """
    piece = max(params.piece_len, 1 << 16) if params.k <= 31 else params.piece_len
    if piece > 1 << 12 and not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    reads = read_reads(spark, paths, format, compression, mode, k=params.k, piece_len=piece)
    counted = Counted(raw_counts(reads, params), params)
    if out:
        write_result(counted.result, out, params, overwrite=True)
    return counted


def histo(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Histogram of a binary result; with out, also as text."""
    found = histogram(read_result(spark, path))
    if out:
        write_histogram(found, out)
    return found


def dump(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Lines of a binary result; with out, also as text."""
    result = read_result(spark, path)
    if out:
        write_dump(result, out)
    return dump_lines(result)
