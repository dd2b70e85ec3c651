"""Column expressions over base strings.  All stay in the JVM.

Case is folded with translate, not upper(): upper() turns some letters outside
ASCII into sequences that hold a base.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(seq: Column | str) -> Column:
    """Bases in upper case, line breaks out; everything else as it is."""
    return F.translate(_column(seq), "acgt\r\n", "ACGT")


def segments(seq: Column | str) -> Column:
    """The runs of valid bases of a read, as an array; runs may be empty."""
    return F.split(normalized(seq), "[^ACGT]+")


def revcomp(kmer: Column | str) -> Column:
    return F.reverse(F.translate(_column(kmer), "ACGT", "TGCA"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(_column(kmer), revcomp(kmer))


def kmer_pack(kmer: Column | str) -> Column:
    """Two bits a base, the first base highest: a BIGINT for up to 31 bases (null beyond)."""
    kmer = _column(kmer)
    return F.when(F.length(kmer) <= 31, F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def kmer_unpack(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_column(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


#: SQL functions of the same meaning, and a table function for LATERAL.
SQL_FUNCTIONS = {
    "revcomp": "revcomp(kmer STRING) RETURNS STRING RETURN reverse(translate(kmer, 'ACGT', 'TGCA'))",
    "canonical_kmer": "canonical_kmer(kmer STRING) RETURNS STRING RETURN least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))",
    "kmer_pack": "kmer_pack(kmer STRING) RETURNS BIGINT RETURN CASE WHEN length(kmer) <= 31 THEN CAST(conv(translate(kmer, 'ACGT', '0123'), 4, 10) AS BIGINT) END",
    "kmer_unpack": "kmer_unpack(code BIGINT, k INT) RETURNS STRING RETURN translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '0123', 'ACGT')",
    "kmers": r"""kmers(seq STRING, k INT) RETURNS TABLE (kmer STRING) RETURN
        SELECT least(substr(s, i, k), substr(reverse(translate(s, 'ACGT', 'TGCA')), length(s) - k + 2 - i, k))
        FROM (SELECT s, explode(sequence(1, length(s) - k + 1)) AS i
              FROM (SELECT explode(split(translate(seq, 'acgt\r\n', 'ACGT'), '[^ACGT]+')) AS s) WHERE length(s) >= k)""",
}


def register_functions(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS known to the session."""
    for text in SQL_FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
