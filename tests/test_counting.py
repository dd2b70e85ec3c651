"""K-mer extraction and counts against goldens and a plain version."""

import random
from collections import Counter

import pytest

from strandloom.operators import dump, exported, histogram, histogram_totals, kmers, pieces, raw_counts, statistics
from strandloom.params import CountParams


def plain(reads, k):
    """The definition, character by character."""
    out = Counter()
    for read in reads:
        run = ""
        for c in [*(read or ""), "|"]:
            if c in "\r\n":
                continue
            c = c.upper() if c in "acgt" else c
            if c in "ACGT":
                run += c
            else:
                for i in range(len(run) - k + 1):
                    w = run[i : i + k]
                    out[min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
                run = ""
    return dict(out)


def counted(spark, reads, k, packed=None, piece_len=1000):
    df = spark.createDataFrame([(r,) for r in reads], "seq string")
    return {r.kmer: r["count"] for r in raw_counts(df, CountParams(k, filter_min=1, piece_len=piece_len), packed=packed).collect()}


FASTA = ["ACGTA", "TCGAT", "ATCGATCG\nAACNCGNN\nGTT", "NNNANNNC\nNNNGNNNN\nT"]
GOLDENS = [
    (FASTA, 1, {"A": 16, "C": 14}),
    (FASTA, 2, {"AA": 2, "AC": 4, "AT": 3, "CG": 5, "GA": 6, "TA": 1}),
    (FASTA, 3, {"AAC": 2, "ACG": 2, "ATC": 4, "CGA": 6, "GAA": 1, "GTA": 1}),
    (FASTA, 4, {"ACGT": 1, "ATCG": 4, "CGAA": 1, "CGTA": 1, "GAAC": 1, "GATC": 1, "TCGA": 3}),
    (FASTA, 5, {"ACGTA": 1, "ATCGA": 4, "CGAAC": 1, "CGATC": 2, "TCGAA": 1}),
    (["ACGTA", "TGCAT", "ATCGA"], 3, {"ACG": 2, "ATC": 1, "ATG": 1, "CGA": 2, "GCA": 2, "GTA": 1}),
    (["ACCGG", "ACGT", "ACCGG", "AGCCCCGG", "CCCG", "ATCG"], 4, {"ACCG": 2, "ACGT": 1, "AGCC": 1, "ATCG": 1, "CCCC": 1, "CCCG": 2, "CCGG": 3, "GCCC": 1}),
    (["AAAAAA", "ACGTAAAAAACGTACG", "AGCT" * 71, "CGAT"], 4, {"AAAA": 6, "AAAC": 1, "AACG": 1, "ACGT": 2, "AGCT": 71, "ATCG": 1, "CGTA": 3, "CTAG": 70, "GCTA": 140, "GTAA": 1, "GTAC": 1, "TAAA": 1}),
    ([">CCT\nGGA"], 3, {"AGG": 1, "CAG": 1, "CCA": 1, "GGA": 1}),
    (["NA\rC\r\nGGCNG\nCNGTAANNACCGNNN"], 3, {"ACG": 1, "CCG": 2, "GCC": 1, "GTA": 1, "TAA": 1, "ACC": 1}),
]


@pytest.mark.parametrize("packed", [True, False])
def test_goldens(spark, packed):
    for reads, k, expected in GOLDENS:
        assert counted(spark, reads, k, packed) == expected == plain(reads, k)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 16, 23, 31, 32, 33, 64, 67, 96])
def test_random_reads(spark, k):
    rng = random.Random(k)
    reads = ["".join(rng.choice("ACGTacgtN\n") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(rng.randint(0, 300))) for _ in range(8)] + [None, "", "é" * 5 + "ACGT" * 30]
    expected = plain(reads, k)
    assert counted(spark, reads, k, piece_len=50) == expected
    if k <= 31:
        assert counted(spark, reads, k, packed=False, piece_len=50) == expected


def test_metamorphic(spark):
    rng = random.Random(1)
    reads = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(5)]
    back = [r[::-1].translate(str.maketrans("ACGT", "TGCA")) for r in reads]
    assert counted(spark, reads, 9) == counted(spark, back, 9) == counted(spark, reads[::-1], 9)
    assert sum(counted(spark, reads, 9).values()) == 5 * 192


def test_pieces_cover_each_window_once(spark):
    df = spark.createDataFrame([("ACGGTTAACC" * 20,)], "seq string")
    for k, size in ((3, 7), (10, 25), (4, 8)):
        cut = [r.piece for r in pieces(df, k, size).collect()]
        assert max(map(len, cut)) <= max(size, 2 * k)
        assert sum(len(p) - k + 1 for p in cut) == 200 - k + 1 == kmers(df, k, size).count()


def test_filter_clamp_stats(spark):
    counts = spark.createDataFrame([("AAA", 1), ("AAC", 2), ("AAG", 300), ("AAT", 2**32 - 1)], "kmer string, count long")
    p = CountParams(3)
    assert sorted(tuple(r) for r in exported(counts, p).collect()) == [("AAC", 2), ("AAG", 255), ("AAT", 255)]
    p = CountParams(3, filter_min=300, count_max=100)  # the filter comes before the cut
    assert sorted(tuple(r) for r in exported(counts, p).collect()) == [("AAG", 100), ("AAT", 100)]
    assert tuple(statistics(counts, CountParams(3, filter_min=2, filter_max=300)).first()) == (303 + 2**32 - 1, 4, 2)
    assert tuple(statistics(counts.limit(0), p).first()) == (0, 0, 0)
    histo = histogram(exported(counts, CountParams(3)))
    assert [tuple(r) for r in histo.collect()] == [(2, 1), (255, 2)]
    assert tuple(histogram_totals(histo).first()) == (512, 3)
    assert sorted(r.value for r in dump(counts).collect())[0] == "AAA\t1"


def test_plan_has_one_exchange(spark):
    df = spark.createDataFrame([("ACGT",)], "seq string")
    plan = raw_counts(df, CountParams(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
