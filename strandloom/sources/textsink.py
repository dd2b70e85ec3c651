"""Text forms of a dump and a histogram: two fields parted by a tab."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counting import dump


def write_dump(result: DataFrame, path: str) -> None:
    dump(result).write.mode("overwrite").text(path)


def write_histogram(histo: DataFrame, path: str) -> None:
    """In ascending order of count, in one file: at most as many lines as there are different counts."""
    lines = histo.orderBy("count").select(F.concat_ws("\t", F.col("count").cast("string"), F.col("n_kmers").cast("string")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
