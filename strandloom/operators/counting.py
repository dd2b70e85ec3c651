"""Counts, filter and clamp, statistics, histogram, dump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kmer_unpack
from ..params import COUNT_LIMIT, CountParams
from .kmers import PACKED_K, kmer_codes, kmers


def raw_counts(reads: DataFrame, params: CountParams, column: str = "seq", packed: bool | None = None) -> DataFrame:
    """kmer, count of every distinct k-mer, before filter and clamp; counts stop at 2**32 - 1.

    One shuffle, of partial counts.  packed: BIGINT keys (the default up to 31
    bases), which are turned into strings after the aggregation.
    """
    if packed is None:
        packed = params.k <= PACKED_K
    limit = F.lit(COUNT_LIMIT).cast("long")
    if packed:
        sums = kmer_codes(reads, params.k, column).groupBy("code").agg(F.least(F.sum("n"), limit).alias("count"))
        return sums.select(kmer_unpack("code", params.k).alias("kmer"), "count")
    return kmers(reads, params.k, params.piece_len, column).groupBy("kmer").agg(F.least(F.count("*"), limit).alias("count"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """kmer, count: the counts of several results (a union of them) added up; they stop at 2**32 - 1."""
    return counts.groupBy("kmer").agg(F.least(F.sum("count"), F.lit(COUNT_LIMIT).cast("long")).alias("count"))


def exported(counts: DataFrame, params: CountParams) -> DataFrame:
    """The k-mers whose raw count lies in the range, with the count cut to count_max."""
    kept = counts.where(F.col("count").between(params.filter_min, params.filter_max))
    return kept.select("kmer", F.least("count", F.lit(params.count_max).cast("long")).alias("count"))


def statistics(counts: DataFrame, params: CountParams) -> DataFrame:
    """One row: total_kmers, unique_kmers, exported_unique_kmers, from raw counts."""
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_kmers"),
        F.count("*").alias("unique_kmers"),
        F.count_if(F.col("count").between(params.filter_min, params.filter_max)).alias("exported_unique_kmers"),
    )


def histogram(counts: DataFrame) -> DataFrame:
    """count, n_kmers in ascending order of count.  Of an exported result, it shows the cut counts."""
    return counts.groupBy("count").agg(F.count("*").alias("n_kmers")).orderBy("count")


def histogram_totals(histo: DataFrame) -> DataFrame:
    """One row: total_kmers, unique_kmers, from a histogram."""
    return histo.agg(F.coalesce(F.sum(F.col("count") * F.col("n_kmers")), F.lit(0)).cast("long").alias("total_kmers"), F.coalesce(F.sum("n_kmers"), F.lit(0)).cast("long").alias("unique_kmers"))


def dump(result: DataFrame) -> DataFrame:
    """One column `value`: k-mer, a tab, count."""
    return result.select(F.concat_ws("\t", "kmer", F.col("count").cast("string")).alias("value"))
