"""Registered queries of the k-mer operators, each with the same query in SQL.

Two sources of reads: the literal texts of documents (prose gives short valid
runs), and made-up reads of 32 bases, the hexadecimal digits of a text's md5
taken as bases.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical, kmer_pack, kmer_unpack, normalized, register_functions, revcomp, segments
from .operators import dump, exported, histogram, histogram_totals, kmers, merged_counts, pieces, raw_counts, statistics
from .params import CountParams

Query = Callable[[SparkSession, str], DataFrame]
_HEX = "0123456789abcdef", "ACGTACGTACGTACGT"


def text_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("seq"))


def dna_reads(spark: SparkSession, sf_dir: str, table: str = "documents", rounds: int = 1) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where("text is not null")
    parts = [F.translate(F.md5(F.concat("text", F.lit(str(i) if i else ""))), *_HEX) for i in range(rounds)]
    return rows.select(F.concat(*parts).alias("seq"))


def _raw(reads: Callable, k: int, packed: bool | None = None, **more) -> Query:
    return lambda spark, d: raw_counts(reads(spark, d, **more), CountParams(k, filter_min=1), packed=packed)


def _kept(k: int, **params) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = CountParams(k, **params)
        return exported(raw_counts(dna_reads(spark, d), p), p)

    return run


def normalize_segments(spark: SparkSession, d: str) -> DataFrame:
    runs = text_reads(spark, d).select("doc_id", F.explode(segments("seq")).alias("run"))
    return runs.where(F.length("run") >= 3).groupBy("run").agg(F.count("*").alias("n"))


def kmer_explode(spark: SparkSession, d: str) -> DataFrame:
    return kmers(dna_reads(spark, d), 12, piece_len=20)


def piece_cutting(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of 24 bases with 6 in common, from runs of 32."""
    return pieces(dna_reads(spark, d), 7, piece_len=24).groupBy("piece").agg(F.count("*").alias("n"))


def revcomp_reads(spark: SparkSession, d: str) -> DataFrame:
    return dna_reads(spark, d).select("seq", revcomp("seq").alias("back"))


def canonical_reads(spark: SparkSession, d: str) -> DataFrame:
    return dna_reads(spark, d).select("seq", canonical("seq").alias("least_strand"))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return text_reads(spark, d).select("doc_id", F.md5(normalized("seq")).alias("md5"))


def stats(spark: SparkSession, d: str) -> DataFrame:
    p = CountParams(7, filter_min=2, filter_max=5)
    return statistics(raw_counts(dna_reads(spark, d), p), p)


def histo(spark: SparkSession, d: str) -> DataFrame:
    return histogram(raw_counts(dna_reads(spark, d), CountParams(7)))


def histo_clamped(spark: SparkSession, d: str) -> DataFrame:
    p = CountParams(4, filter_min=1, count_max=100)
    return histogram(exported(raw_counts(dna_reads(spark, d), p), p))


def histo_totals(spark: SparkSession, d: str) -> DataFrame:
    return histogram_totals(histo(spark, d))


def dump_lines(spark: SparkSession, d: str) -> DataFrame:
    return dump(_kept(7, filter_min=3)(spark, d))


def pack_kmer(spark: SparkSession, d: str) -> DataFrame:
    return raw_counts(dna_reads(spark, d), CountParams(9)).select("kmer", kmer_pack("kmer").alias("code"))


def unpack_kmer(spark: SparkSession, d: str) -> DataFrame:
    return pack_kmer(spark, d).select("code", kmer_unpack("code", 9).alias("kmer"))


def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    both = dna_reads(spark, d).unionByName(dna_reads(spark, d, "benchmark"))
    return raw_counts(both, CountParams(6))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions, from SQL."""
    register_functions(spark)
    dna_reads(spark, d).createOrReplaceTempView("strandloom_reads")
    return spark.sql("SELECT seq, revcomp(seq) AS back, canonical_kmer(substr(seq, 1, 9)) AS head, kmer_pack(substr(seq, 1, 9)) AS code, kmer_unpack(kmer_pack(substr(seq, 1, 9)), 9) AS again FROM strandloom_reads")


def table_function(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    dna_reads(spark, d).createOrReplaceTempView("strandloom_reads")
    return spark.sql("SELECT k.kmer, count(*) AS count FROM strandloom_reads, LATERAL kmers(seq, 5) AS k GROUP BY k.kmer")


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir,
    or a temporary one where that is unset and the master is local."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return f"{shared.rstrip('/')}/strandloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="strandloom-")


def _files(spark: SparkSession, reads: DataFrame, fastq: bool, gz: bool = False, one_line: bool = False) -> str:
    """Each row as a record of text files."""
    folder = _folder(spark)
    wrapped = F.col("seq") if one_line else F.concat(F.substring("seq", 1, 10), F.lit("\n"), F.expr("substring(seq, 11)"))
    line = F.concat(F.lit("@r\n"), "seq", F.lit("\n+\n"), "seq") if fastq else F.concat(F.lit(">r\n"), wrapped)
    reads.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip" if gz else "none").text(f"{folder}/reads")
    return f"{folder}/reads"


def fasta_parse(spark: SparkSession, d: str) -> DataFrame:
    from .sources import read_reads

    return raw_counts(read_reads(spark, _files(spark, dna_reads(spark, d), False), "fasta", split_bytes=4096), CountParams(7))


def fastq_parse(spark: SparkSession, d: str) -> DataFrame:
    from .sources import read_reads

    return raw_counts(read_reads(spark, _files(spark, dna_reads(spark, d), True), "fastq", split_bytes=4096), CountParams(7))


def gzip_parse(spark: SparkSession, d: str) -> DataFrame:
    from .sources import read_reads

    return raw_counts(read_reads(spark, _files(spark, dna_reads(spark, d), False, gz=True), "fasta"), CountParams(7))


def fasta_long_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of one line each that many ranges of a file share."""
    from .sources import read_reads

    reads = dna_reads(spark, d).select(F.repeat("seq", 60).alias("seq"))
    path = _files(spark, reads, False, one_line=True)
    return raw_counts(read_reads(spark, path, "fasta", k=11, piece_len=100, split_bytes=1000), CountParams(11))


def _result(spark: SparkSession, d: str, layout: str = "file") -> str:
    """The binary result of the count command over FASTQ files."""
    from .plans import count
    from .sources import write_result

    p, path = CountParams(7, filter_min=2), f"{_folder(spark)}/result"
    counted = count(spark, _files(spark, dna_reads(spark, d), True), p, "fastq")
    write_result(counted.result, path, p, layout=layout)
    return path


def count_command(spark: SparkSession, d: str) -> DataFrame:
    from .sources import read_result

    return read_result(spark, _result(spark, d))


def count_command_parts(spark: SparkSession, d: str) -> DataFrame:
    from .sources import read_result

    return read_result(spark, _result(spark, d, "parts"))


def count_command_stats(spark: SparkSession, d: str) -> DataFrame:
    from .plans import count

    return count(spark, _files(spark, dna_reads(spark, d), False), CountParams(7, filter_min=2, filter_max=5), "fasta").stats


def histo_command(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the written histogram, with their places."""
    from .plans import histo as command

    path = f"{_folder(spark)}/histo"
    command(spark, _result(spark, d), path)
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("place", "value"))


def dump_command(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the written dump."""
    from .plans import dump as command

    path = f"{_folder(spark)}/dump"
    command(spark, _result(spark, d), path)
    return spark.read.text(path)


def filter_min_above_max(spark: SparkSession, d: str) -> DataFrame:
    """An empty result."""
    return _kept(7, filter_min=4, filter_max=2)(spark, d)


def saturated_counts(spark: SparkSession, d: str) -> DataFrame:
    """Results of many runs added up, beyond the limit of a count."""
    counts = raw_counts(dna_reads(spark, d), CountParams(4)).withColumn("count", F.col("count") * 30_000_000)
    return merged_counts(counts.unionByName(counts))


def binary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from .sources import read_result, write_result

    path = f"{_folder(spark)}/result"
    p = CountParams(7, filter_min=2)
    write_result(_kept(7, filter_min=2)(spark, d), path, p)
    return read_result(spark, path)


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """The count over a stream of the table's file, taken to its end."""
    from .streaming import stream_counts as counted
    from .streaming import write_counts

    source, path = f"{d}/documents.parquet", f"{_folder(spark)}/stream"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(f"{source}*").where("text is not null")
    reads = rows.select(F.translate(F.md5("text"), *_HEX).alias("seq"))
    run = write_counts(counted(reads, CountParams(7)), path).trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 0
    return spark.read.schema("kmer string, count long").parquet(f"{path}/trigger-{last}")


def queries() -> dict[str, Query]:
    return {
        "count_k7_dna": _raw(dna_reads, 7),
        "normalized_text": normalized_text,
        "normalize_segments": normalize_segments,
        "piece_cutting": piece_cutting,
        "kmer_explode": kmer_explode,
        "revcomp": revcomp_reads,
        "canonical": canonical_reads,
        "count_k1_text": _raw(text_reads, 1),
        "count_k3_text": _raw(text_reads, 3),
        "count_k3_text_expressions": _raw(text_reads, 3, packed=False),
        "count_even_k_palindromes": _raw(dna_reads, 4),
        "count_k31_dna": _raw(dna_reads, 31),
        "count_k32_dna": _raw(dna_reads, 32),
        "count_k67_dna": _raw(dna_reads, 67, rounds=3),
        "count_filter_min": _kept(7, filter_min=3),
        "count_filter_range": _kept(7, filter_min=2, filter_max=4),
        "count_clamp_255": _kept(3, filter_min=1),
        "count_filter_then_clamp": _kept(4, filter_min=150, count_max=100),
        "stats": stats,
        "histo": histo,
        "histo_clamped": histo_clamped,
        "histo_totals": histo_totals,
        "dump": dump_lines,
        "pack_kmer": pack_kmer,
        "unpack_kmer": unpack_kmer,
        "union_of_sources": union_of_sources,
        "sql_functions": sql_functions,
        "table_function": table_function,
        "fasta_parse": fasta_parse,
        "fastq_parse": fastq_parse,
        "binary_roundtrip": binary_roundtrip,
        "gzip_parse": gzip_parse,
        "fasta_long_records": fasta_long_records,
        "count_command": count_command,
        "count_command_parts": count_command_parts,
        "count_command_stats": count_command_stats,
        "histo_command": histo_command,
        "dump_command": dump_command,
        "filter_min_above_max": filter_min_above_max,
        "saturated_counts": saturated_counts,
        "stream_counts": stream_counts,
    }


_DNA = "SELECT translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM {table} WHERE text IS NOT NULL"
_DNA3 = "SELECT " + " || ".join(f"translate(md5(text || '{i}'), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in ("", 1, 2)) + " AS seq FROM documents WHERE text IS NOT NULL"
_TEXT = "SELECT text AS seq FROM documents"


def _counted(reads: str, k: int) -> str:
    """A WITH clause that ends in `raw` (kmer, count)."""
    return f"""WITH runs AS (SELECT unnest(regexp_split_to_array(regexp_replace(translate(seq, 'acgt', 'ACGT'), '[\\r\\n]', '', 'g'), '[^ACGT]+')) AS run FROM ({reads})),
        fit AS (SELECT run, reverse(translate(run, 'ACGT', 'TGCA')) AS back, length(run) AS n FROM runs WHERE length(run) >= {k}),
        spots AS (SELECT run, back, n, unnest(range(1, n - {k} + 2)) AS i FROM fit),
        windows AS (SELECT least(substr(run, i, {k}), substr(back, n - {k} + 2 - i, {k})) AS kmer FROM spots),
        raw AS (SELECT kmer, count(*) AS "count" FROM windows GROUP BY kmer) """


def oracle_sql() -> dict[str, str]:
    dna = _DNA.format(table="documents")
    raw7 = _counted(dna, 7)
    code = " + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (8 - i)}" for i in range(9))
    head = "least(substr(seq, 1, 9), reverse(translate(substr(seq, 1, 9), 'ACGT', 'TGCA')))"
    bins = 'SELECT "count", count(*) AS n_kmers FROM ({}) GROUP BY "count" ORDER BY "count"'
    return {
        "count_k7_dna": raw7 + "SELECT * FROM raw",
        "normalized_text": "SELECT doc_id, md5(regexp_replace(translate(text, 'acgt', 'ACGT'), '[\\r\\n]', '', 'g')) AS md5 FROM documents",
        "normalize_segments": _counted(_TEXT, 3) + "SELECT run, count(*) AS n FROM fit GROUP BY run",
        "piece_cutting": f"WITH r AS ({dna}), p AS (SELECT substr(seq, unnest([1, 19]), 24) AS piece FROM r) SELECT piece, count(*) AS n FROM p GROUP BY piece",
        "kmer_explode": _counted(dna, 12) + "SELECT kmer FROM windows",
        "revcomp": f"SELECT seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS back FROM ({dna})",
        "canonical": f"SELECT seq, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS least_strand FROM ({dna})",
        "count_k1_text": _counted(_TEXT, 1) + "SELECT * FROM raw",
        "count_k3_text": _counted(_TEXT, 3) + "SELECT * FROM raw",
        "count_k3_text_expressions": _counted(_TEXT, 3) + "SELECT * FROM raw",
        "count_even_k_palindromes": _counted(dna, 4) + "SELECT * FROM raw",
        "count_k31_dna": _counted(dna, 31) + "SELECT * FROM raw",
        "count_k32_dna": _counted(dna, 32) + "SELECT * FROM raw",
        "count_k67_dna": _counted(_DNA3, 67) + "SELECT * FROM raw",
        "count_filter_min": raw7 + 'SELECT kmer, least("count", 255) AS "count" FROM raw WHERE "count" >= 3',
        "count_filter_range": raw7 + 'SELECT kmer, least("count", 255) AS "count" FROM raw WHERE "count" BETWEEN 2 AND 4',
        "count_clamp_255": _counted(dna, 3) + 'SELECT kmer, least("count", 255) AS "count" FROM raw',
        "count_filter_then_clamp": _counted(dna, 4) + 'SELECT kmer, least("count", 100) AS "count" FROM raw WHERE "count" >= 150',
        "stats": raw7 + 'SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) AS total_kmers, count(*) AS unique_kmers, count(*) FILTER (WHERE "count" BETWEEN 2 AND 5) AS exported_unique_kmers FROM raw',
        "histo": raw7 + bins.format("SELECT * FROM raw"),
        "histo_clamped": _counted(dna, 4) + bins.format('SELECT least("count", 100) AS "count" FROM raw'),
        "histo_totals": raw7 + 'SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) AS total_kmers, count(*) AS unique_kmers FROM raw',
        "dump": raw7 + "SELECT kmer || chr(9) || CAST(least(\"count\", 255) AS VARCHAR) AS value FROM raw WHERE \"count\" >= 3",
        "pack_kmer": _counted(dna, 9) + f"SELECT kmer, CAST({code} AS BIGINT) AS code FROM raw",
        "unpack_kmer": _counted(dna, 9) + f"SELECT CAST({code} AS BIGINT) AS code, kmer FROM raw",
        "union_of_sources": _counted(dna + " UNION ALL " + _DNA.format(table="benchmark"), 6) + "SELECT * FROM raw",
        "sql_functions": f"SELECT seq, back, kmer AS head, CAST({code.replace('kmer', 'own')} AS BIGINT) AS code, own AS again FROM (SELECT seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS back, {head} AS kmer, substr(seq, 1, 9) AS own FROM ({dna}))",
        "table_function": _counted(dna, 5) + "SELECT * FROM raw",
        "fasta_parse": raw7 + "SELECT * FROM raw",
        "fastq_parse": raw7 + "SELECT * FROM raw",
        "binary_roundtrip": raw7 + 'SELECT kmer, least("count", 255) AS "count" FROM raw WHERE "count" >= 2',
        "gzip_parse": raw7 + "SELECT * FROM raw",
        "fasta_long_records": _counted(f"SELECT repeat(seq, 60) AS seq FROM ({dna})", 11) + "SELECT * FROM raw",
        "count_command": raw7 + 'SELECT kmer, least("count", 255) AS "count" FROM raw WHERE "count" >= 2',
        "count_command_parts": raw7 + 'SELECT kmer, least("count", 255) AS "count" FROM raw WHERE "count" >= 2',
        "count_command_stats": raw7 + 'SELECT CAST(coalesce(sum("count"), 0) AS BIGINT) AS total_kmers, count(*) AS unique_kmers, count(*) FILTER (WHERE "count" BETWEEN 2 AND 5) AS exported_unique_kmers FROM raw',
        "histo_command": raw7 + ", bins AS (" + bins.format('SELECT least("count", 255) AS "count" FROM raw WHERE "count" >= 2') + """)
            SELECT CAST(row_number() OVER (ORDER BY "count") - 1 AS INTEGER) AS place, CAST("count" AS VARCHAR) || chr(9) || CAST(n_kmers AS VARCHAR) AS value FROM bins""",
        "dump_command": raw7 + "SELECT kmer || chr(9) || CAST(least(\"count\", 255) AS VARCHAR) AS value FROM raw WHERE \"count\" >= 2",
        "filter_min_above_max": raw7 + 'SELECT * FROM raw WHERE "count" >= 4 AND "count" <= 2',
        "saturated_counts": _counted(dna, 4) + 'SELECT kmer, least(2 * "count" * 30000000, 4294967295) AS "count" FROM raw',
        "stream_counts": raw7 + "SELECT * FROM raw",
    }
