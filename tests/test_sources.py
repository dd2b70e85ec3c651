"""Readers and writers."""

import gzip
import io
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import raw_counts
from strandloom.params import CountParams
from strandloom.plans import count, dump, histo
from strandloom.sources import read_header, read_reads, read_result, write_dump, write_histogram, write_result
from strandloom.sources import fastx, files
from strandloom.sources.fastx import cut, fasta_records, fasta_windows, fastq_records, lines_of
from strandloom.sources.kmerbin import decode, encode

FASTA = b"---\n>\n\n>-->-\nAACCGGTT\n>\nACGT\n>\n\rAA\nCC\r\nGG\rTT\n\n\n>\n\r\n\rACGT\r\n\n\rTGCA"
READS = [b"", b"AACCGGTT", b"ACGT", b"\rAA\nCC\r\nGG\rTT\n\n", b"\r\n\rACGT\r\n\n\rTGCA"]


def parsed(records):
    return [b"".join(parts) for _, _, parts in records]


def test_fasta_goldens():
    assert parsed(fasta_records(lines_of(io.BytesIO(FASTA)))) == READS
    assert parsed(fasta_records(lines_of(io.BytesIO(b">ACG\n>CCT\nGGA")))) == [b">CCT\nGGA"]
    assert parsed(fasta_records(lines_of(io.BytesIO(b">ACG\n>CCT\nGGA")), strict=True)) == [b"", b"GGA"]
    assert parsed(fasta_records(lines_of(io.BytesIO(b"no header\nACGT")))) == []


def test_fastq_goldens():
    text = b"---\n@\n\n+\n+\n@--@-\nAACCGGTT\n+\n@---\n@\nACGT\n+"
    assert parsed(fastq_records(lines_of(io.BytesIO(text)))) == [b"", b"AACCGGTT", b"ACGT"]
    assert parsed(fastq_records(lines_of(io.BytesIO(b"@h\nAC\nGT\n+\n----")))) == []
    assert parsed(fastq_records(lines_of(io.BytesIO(b"@h\nACGT\n+\n@@@@\n@i\nTTTT\n+\n----")))) == [b"ACGT", b"TTTT"]


def test_cut_keeps_each_window_once():
    rng = random.Random(0)
    seq = bytes(rng.choice(b"ACGTN") for _ in range(503))
    parts = [seq[i : i + 17] + b"\n" for i in range(0, 503, 17)]
    assert list(cut(iter(parts), None, 10)) == [b"".join(parts)]
    for k, size in ((1, 10), (5, 23), (40, 50)):
        out = list(cut(iter(parts), k, size))
        assert [p[i : i + k] for p in out for i in range(len(p) - k + 1)] == [seq[i : i + k] for i in range(503 - k + 1)]


def test_ranges_agree_with_the_whole(spark, tmp_path):
    rng = random.Random(4)
    fasta = "".join(rng.choice([">", ">x\n", "\r", "\n", "\r\n", "ACG", "T", ">>\n"]) for _ in range(3000))
    fastq = "".join(rng.choice(["@h\nACGT\n+\nIIII\n", "@a\r\nTTGA\r\n+\r\n@@@@\r\n", "junk\n", "@\n+\n"]) for _ in range(400))
    for kind, text in (("fasta", fasta), ("fastq", fastq)):
        path = tmp_path / f"x.{kind}"
        path.write_bytes(text.encode())
        whole = sorted(tuple(r)[1:] for r in read_reads(spark, str(path), kind).collect())
        assert whole
        for size in (37, 101, 1000):
            assert sorted(tuple(r)[1:] for r in read_reads(spark, str(path), kind, split_bytes=size).collect()) == whole


def windows(pieces, k):
    return Counter(p[i : i + k] for p in pieces for i in range(len(p) - k + 1))


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_ranges_share_out_windows(monkeypatch, block):
    monkeypatch.setattr(fastx, "BLOCK", block)
    rng = random.Random(6)
    for turn in range(60):
        words = [">", ">x\n", ">a\r\n", "\r", "\n", "\r\n", "ACG", "TTGCA", "N", ">>\n"]
        text = "".join(rng.choice(words) for _ in range(rng.randint(0, 60))).encode()
        if turn % 5 == 0:
            text = b">one\n" + bytes(rng.choice(b"ACGT") for _ in range(300))
        for strict in (False, True):
            records = [(o, h, b"".join(p)) for o, h, p in fasta_records(lines_of(io.BytesIO(text)), strict)]
            for k in (1, 4):
                expected = sum((windows([seq.translate(None, b"\r\n")], k) for _, _, seq in records), Counter())
                for step in (7, 40, 10_000):
                    edges = [*range(0, max(len(text), 1), step), None]
                    found = [x for a, b in zip(edges, edges[1:]) for x in fasta_windows(io.BytesIO(text), a, b, k, 12, strict)]
                    assert windows([p for *_, p in found], k) == expected
                    assert sorted((o, h) for o, n, h, _ in found if n == 0) == sorted((o, h) for o, h, _ in records)


def test_a_long_line_takes_linear_time(tmp_path):
    path = str(tmp_path / "long.fa")
    with open(path, "wb") as f:
        f.write(b">long\n")
        for _ in range(48):
            f.write(b"ACGTTGCA" * (1 << 17))
    reader = fastx.FastxReader({"path": path, "k": "25", "piece_len": "65536", "split_bytes": str(8 << 20)})
    parts, begin = reader.partitions(), time.time()
    assert len(parts) == 7
    total = sum(len(seq) - 24 for p in parts for *_, seq in reader.read(p))
    assert total == (48 << 20) - 24 and time.time() - begin < 20


class Watched:
    """A stream that adds up the bytes read."""

    total = 0

    def __init__(self, stream):
        self.stream, self.seek = stream, stream.seek

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def read(self, n):
        data = self.stream.read(n)
        Watched.total += len(data)
        return data


@pytest.mark.parametrize("line", [1920, 3 << 20])
def test_short_ranges_share_tasks(monkeypatch, tmp_path, line):
    rng = np.random.default_rng(7)
    text = b"".join(b">r%d\n%s\n" % (i, rng.choice(list(b"ACGT"), line).astype(np.uint8).tobytes()) for i in range((3 << 20) // line))
    path = str(tmp_path / "long.fa")
    with open(path, "wb") as f:
        f.write(text)
    monkeypatch.setattr(Watched, "total", 0)
    monkeypatch.setattr(files, "opened", lambda path, opened=files.opened: Watched(opened(path)))
    reader = fastx.FastxReader({"path": path, "k": "11", "piece_len": "100", "split_bytes": "1000"})
    parts = reader.partitions()
    assert len(parts) == 2  # and not one for each of 3,000 ranges
    found = [row[1:] for p in parts for row in reader.read(p)]
    assert Watched.total < 4 * len(text)
    edges = [*range(0, len(text), 1000), None]
    ranges = [x for a, b in zip(edges, edges[1:]) for x in fasta_windows(io.BytesIO(text), a, b, 11, 100)]
    assert found == [(o, n, h and h.decode(), s.decode()) for o, n, h, s in ranges]


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
def test_ranges_of_whole_records_are_read_as_one(monkeypatch, tmp_path, kind):
    rng = np.random.default_rng(8)
    reads = [rng.choice(list(b"ACGT"), n).astype(np.uint8).tobytes().decode() for n in rng.integers(0, 60, 40_000)]
    text = "".join(f"@r{i}\n{s}\n+\n{s}\n" if kind == "fastq" else f">r{i}\n{s}\n" for i, s in enumerate(reads)).encode()
    path = str(tmp_path / "x")
    with open(path, "wb") as f:
        f.write(text)
    monkeypatch.setattr(Watched, "total", 0)
    monkeypatch.setattr(files, "opened", lambda path, opened=files.opened: Watched(opened(path)))
    reader = fastx.FastxReader({"path": path, "format": kind, "split_bytes": "4096"})
    parts = reader.partitions()
    assert len(parts) == -(-len(text) // (2 << 20)) and len(text) > 1 << 20  # and not one for each 4,096 bytes
    rows = [row for p in parts for row in reader.read(p)]
    assert [row[3:] for row in rows] == [(f"r{i}", s) for i, s in enumerate(reads)]
    assert Watched.total < 3 * len(text)


def test_files(tmp_path):
    (tmp_path / "b.fa").write_text("x")
    (tmp_path / "a.fa").write_text("xy")
    (tmp_path / ".hidden").write_text("x")
    for path in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/*.fa"):
        assert [f.rsplit("/", 1)[1] for f in files.listed(path)] == ["a.fa", "b.fa"]
    assert files.size(f"file://{tmp_path}/a.fa") == 2 and files.listed("/no/such") == ["/no/such"]
    with pytest.raises(FileNotFoundError):
        files.size("/no/such")


def test_gzip(spark, tmp_path):
    a, b = b">a\nACGTA\n", b">b\nTTGCA\n"
    (tmp_path / "x.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    for compression in ("gzip", "auto"):
        assert sorted(r.seq for r in read_reads(spark, str(tmp_path / "x.gz"), compression=compression).collect()) == ["ACGTA", "TTGCA"]
    (tmp_path / "y.gz").write_bytes(gzip.compress(a)[:-6])
    with pytest.raises(Exception, match="EOF|end-of-stream"):
        read_reads(spark, str(tmp_path / "y.gz")).collect()


def test_binary_goldens(spark, tmp_path):
    kmer = "CCCGTTACGCCTACGTTAACGTGCACTGCCGGC"
    data = bytes.fromhex("6979E4066F5CC65B01")
    rows = spark.createDataFrame([(kmer, 500), ("CGGCCCCGTTACGCCTACGTTAACGTGCACTGC", 1)], "kmer string, count long")
    for count_max, filter_min, width, expected in ((255, 1, 1, {255, 1}), (300, 1, 2, {300, 1}), (2**32 - 1, 2, 4, {500})):
        p = CountParams(33, count_max=count_max, filter_min=filter_min)
        from strandloom.operators import exported

        path = str(tmp_path / f"r{count_max}")
        write_result(exported(rows, p), path, p)
        raw = open(path, "rb").read()
        assert len(raw) == 32 + len(expected) * (9 + width) and data in raw
        assert read_header(path) == CountParams(33, count_max=count_max, filter_min=filter_min)
        assert {r["count"] for r in read_result(spark, path).collect()} == expected


def test_records_are_those_of_whole_numbers():
    rng = random.Random(3)
    for k, most in ((1, 255), (4, 255), (5, 70_000), (31, 300), (33, 2**32 - 1), (67, 255)):
        p = CountParams(k, count_max=most)
        rows = [("".join(rng.choice("ACGT") for _ in range(k)), rng.randint(1, most)) for _ in range(50)]
        plain = b"".join(int(s.translate(str.maketrans("ACGT", "0123")), 4).to_bytes(p.kmer_bytes, "little") + n.to_bytes(p.count_bytes, "little") for s, n in rows)
        kmers = pa.array(["x"] + [s for s, _ in rows]).slice(1)
        assert encode(kmers, np.array([n for _, n in rows]), p) == plain
        assert [tuple(r.values()) for r in decode(plain, p).to_pylist()] == rows
        assert encode(kmers.slice(0, 0), np.zeros(0, np.int64), p) == b"" and decode(b"", p).num_rows == 0
    for kmer, n in (("ACG", 1), ("ACGN", 1), ("ACGT", 256)):
        with pytest.raises(ValueError):
            encode(pa.array([kmer]), np.array([n]), CountParams(4))


def test_a_folder_of_parts(spark, tmp_path):
    p = CountParams(4, filter_min=1)
    rows = spark.createDataFrame([("ACGT", 3), ("AAAA", 1), ("CCCC", 255)], "kmer string, count long")
    for name, df in (("some", rows.repartition(3)), ("none", rows.limit(0))):
        path = str(tmp_path / name)
        for _ in range(2):
            write_result(df, path, p, overwrite=True, layout="parts")
        assert read_header(path) == CountParams(4, filter_min=1)
        assert sorted(map(tuple, read_result(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert not [f for f in os.listdir(tmp_path) if "parts" in f]


def test_damaged_binary(spark, tmp_path):
    (tmp_path / "short").write_bytes(b"123")
    with pytest.raises(ValueError):
        read_header(str(tmp_path / "short"))
    p = CountParams(3)
    write_result(spark.createDataFrame([("ACG", 2)], "kmer string, count long"), str(tmp_path / "r"), p)
    with open(tmp_path / "r", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="cut off"):
        read_result(spark, str(tmp_path / "r")).collect()


def test_commands(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACCGGACCGG\n>b\nACCGG\n")
    out = str(tmp_path / "out")
    p = CountParams(4)
    counted = count(spark, str(tmp_path / "a.fa"), p, out=out)
    expected = {"ACCG": 3, "CCGG": 3, "CGGA": 1, "GGAC": 1, "GACC": 1}
    got = {r.kmer: r["count"] for r in counted.raw.collect()}
    assert sum(got.values()) == 9 and got["CCGG"] == 3
    assert {r.kmer for r in read_result(spark, out).collect()} == {k for k, v in got.items() if v >= 2}
    assert tuple(counted.stats.first())[0] == sum(got.values())
    lines = [tuple(r) for r in histo(spark, out, str(tmp_path / "h")).collect()]
    assert lines and all(c >= 2 for c, _ in lines)
    assert dump(spark, out, str(tmp_path / "d")).count() == len([v for v in got.values() if v >= 2])
    assert spark.read.text(str(tmp_path / "h")).count() == len(lines)
    del expected


def test_cli(spark, tmp_path):
    from strandloom.cli import main

    (tmp_path / "a.fq").write_text("@a\nACGTACGT\n+\nIIIIIIII\n")
    out = str(tmp_path / "o")
    main(["count", str(tmp_path / "a.fq"), "--fq", "-k", "4", "-o", out, "-m", "1g"], spark)
    main(["histo", out, "-o", str(tmp_path / "h")], spark)
    main(["dump", out, "-o", str(tmp_path / "d")], spark)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["ACGT\t2", "CGTA\t2"]
    with pytest.raises(SystemExit):
        main(["count", "x", "--fa"], spark)


def test_stream_equals_batch(spark, tmp_path):
    from strandloom.streaming import stream_counts

    reads = spark.createDataFrame([("ACGTTGCA",), ("TTGCAAC",), ("ACGNTT",)], "seq string").repartition(3)
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_counts(stream, CountParams(3)).writeStream.outputMode("complete").format("memory").queryName("strand_test").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("strand_test").collect())) == sorted(map(tuple, raw_counts(reads, CountParams(3)).collect()))


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("ACG", 2), ("CCC", 5)], "kmer string, count long")
    write_dump(rows, str(tmp_path / "d"))
    write_histogram(spark.createDataFrame([(5, 1), (2, 7)], "count long, n_kmers long"), str(tmp_path / "h"))
    assert [r.value for r in spark.read.text(str(tmp_path / "h")).collect()] == ["2\t7", "5\t1"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["ACG\t2", "CCC\t5"]
