"""The registered queries of this subpackage: opN_<name>, each over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, decontam, htmltext, langid, oracles, packing, pii, records, simhash, substring, toxicity


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode documents, write record files, and report what the files hold."""
    path = common.scratch_path(spark, "records")
    records.write_records(common.table(spark, sf_dir, "documents"), path)
    return records.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "byte_start", "byte_size")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that aren't held out, predict all."""
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)))
    profiles = langid.train(docs.where("not held_out and doc_id is not null"))
    return langid.predict(docs, profiles, keep=[F.col("held_out")])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), radius=3, words_per_shingle=3)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labelled rows that aren't held out, score all documents."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(common.crc_mod("doc_id", 5) != 0))
    held_out = F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model, keep=[held_out])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pii.digest(pii.find_spans(docs, *pii.fit(docs)))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), capacity=2048)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(common.table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(common.table(spark, sf_dir, "documents"), width=35)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_token_records": op1_token_records,
        "op2_language_id": op2_language_id,
        "op3_decontamination": op3_decontamination,
        "op4_simhash_groups": op4_simhash_groups,
        "op5_toxicity": op5_toxicity,
        "op6_personal_data": op6_personal_data,
        "op7_nearest_vectors": op7_nearest_vectors,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_main_text": op9_main_text,
        "op10_substring_dedup": op10_substring_dedup,
    }
    return {name: _bounded(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the query; tests/llm holds the others against plain versions."""
    return {"op3_decontamination": oracles.DECONTAMINATION, "op10_substring_dedup": oracles.SUBSTRING}
