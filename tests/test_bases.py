"""Parameters and base expressions."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import canonical, kmer_pack, kmer_unpack, normalized, revcomp, segments
from strandloom.params import CountParams


@pytest.mark.parametrize("bad", [{"k": 0}, {"k": "3"}, {"k": 3, "filter_min": 0}, {"k": 3, "count_max": 2**32}, {"k": True}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        CountParams(**bad)


def test_widths():
    assert [CountParams(3, count_max=c).count_bytes for c in (255, 256, 65535, 65536)] == [1, 2, 2, 4]
    assert [CountParams(k).kmer_bytes for k in (1, 4, 5, 33)] == [1, 1, 2, 9]


def test_expressions(spark):
    df = spark.createDataFrame([("acGT\r\nnA",), ("",), (None,), ("ẗACG",)], "seq string")
    rows = df.select(normalized("seq").alias("n"), F.filter(segments("seq"), lambda s: s != "").alias("s")).collect()
    assert [r.n for r in rows] == ["ACGTnA", "", None, "ẗACG"]
    assert [r.s for r in rows] == [["ACGT", "A"], [], None, ["ACG"]]
    kmers = spark.createDataFrame([("ACCG",), ("TTTT",), ("ACGT",), ("T" * 31,), ("T" * 32,)], "kmer string")
    out = kmers.select("kmer", revcomp("kmer").alias("r"), canonical("kmer").alias("c"), kmer_pack("kmer").alias("p")).collect()
    assert [(r.r, r.c) for r in out[:3]] == [("CGGT", "ACCG"), ("AAAA", "AAAA"), ("ACGT", "ACGT")]
    assert [r.p for r in out] == [0x16, 0xFF, 0x1B, 2**62 - 1, None]
    assert kmers.limit(1).select(kmer_unpack(kmer_pack("kmer"), 4).alias("x")).first().x == "ACCG"
