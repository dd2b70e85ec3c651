"""The pipeline's stages on a small folder of tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import queries

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(40)
    rows = [(i, prose(RNG.randint(30, 200))) for i in range(200)]
    for i in range(0, 200, 4):
        rows[i] = (i, rows[i][1] + " vile nasty vile")
    long = prose(250).split()
    rows += [(300, " ".join(long)), (301, " ".join(long)), (302, " ".join(long[:100] + ["zzz"] + long[101:])), (303, prose(30) + " " + item + " " + prose(30)), (304, "write to me.too@mail.org " + prose(20)), (305, None), (306, ""), (None, prose(30)), (307, prose(9)), (307, prose(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(7))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = Counter(r.doc_id for r in docs.collect())
    clean = {i for i in range(200) if i % 4}
    assert not {i for i in range(0, 200, 4)} & set(kept["toxicity"]) and clean <= set(kept["toxicity"])
    after = kept["near_duplicates"]
    assert clean | {300, 303, 304} <= set(after) and not {301, 302} & set(after)
    assert after[307] == 2 and after[None] == 1 and after[305] + after[306] == 1
    assert 303 not in kept["decontamination"] and kept["decontamination"] + Counter([303]) == after
    text = {r.doc_id: r for r in docs.collect()}
    assert text[304].text.startswith("write to <email> ") and text[304].n_chars == len(text[304].text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert Counter(r.doc_id for r in pieces.where("piece = 0").collect()) == kept["personal_data"]


def test_clean_rows_without_an_id_of_their_own_stay(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    hit, others = prose(10) + " " + item, [prose(30) for _ in range(4)]
    rows = [(None, hit), (None, others[0]), (None, None), (7, item), (7, others[1]), (7, others[2]), (8, others[3]), (9, hit)]
    found = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert Counter(tuple(r) for r in found.collect()) == Counter((i, t) for i, t in rows if t is None or item not in t)


def test_stages_on_an_empty_table(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder).count() == 0


def test_run_is_the_stages(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 100 and found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_queries_are_named():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
