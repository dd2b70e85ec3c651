"""K-mer counts of a stream of reads.

Windows of different reads are independent, so the batch chain runs on a stream
as it is.  Counts are raw (mode complete or update); filter and clamp belong
behind the sink, since a later batch may still lift a k-mer into the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import raw_counts
from ..params import CountParams


def stream_counts(reads: DataFrame, params: CountParams, column: str = "seq") -> DataFrame:
    """kmer, count over all reads so far; reads is a streaming DataFrame."""
    return raw_counts(reads, params, column)


def write_counts(counts: DataFrame, path: str):
    """A query that keeps the latest counts of a stream as Parquet below path: each trigger writes a
    folder of its own, and drops none, so a reader of the one before is not disturbed."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/trigger-{number}")

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")


__all__ = ["stream_counts", "write_counts"]
