"""The data source "kmerbin": the compact binary form of a result.

A file is a header of four unsigned 64-bit integers (k, count_max, filter_min,
filter_max) and records of equal width: the k-mer, two bits a base with the
first base highest, in ceil(k / 4) bytes, and the count in 1, 2 or 4 bytes, all
little-endian.  Tasks write parts; the commit joins them behind one header, or, with
``layout`` parts, leaves a folder of files that each have a header, which no single
process has to copy.  Reading deals out ranges of records of a file or a folder.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..params import CountParams
from . import files

HEADER = struct.Struct("<4Q")
_BASES = np.frombuffer(b"ACGT", np.uint8)
_CODES = np.full(256, 255, np.uint8)
_CODES[_BASES] = np.arange(4)
#: The four bases of each byte, the first one highest.
_FOUR = _BASES[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]
SCHEMA = pa.schema([("kmer", pa.string()), ("count", pa.int64())])


def encode(kmers: pa.Array, counts: np.ndarray, params: CountParams) -> bytes:
    """Records of k-mers (all of k bases) and their counts."""
    kmers, n = kmers.cast(pa.large_binary()), len(kmers)
    offsets = np.frombuffer(kmers.buffers()[1], np.int64)[kmers.offset : kmers.offset + n + 1]
    if kmers.null_count or (np.diff(offsets) != params.k).any():
        raise ValueError(f"every k-mer must have {params.k} bases")
    codes = np.zeros((n, 4 * params.kmer_bytes), np.uint8)
    if n:
        codes[:, -params.k :] = _CODES[np.frombuffer(kmers.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].reshape(n, params.k)
    if (codes == 255).any():
        raise ValueError("a k-mer has a sign that is no base")
    if n and not 0 <= counts.min() <= counts.max() < 256**params.count_bytes:
        raise ValueError(f"a count doesn't fit into {params.count_bytes} bytes")
    fours = codes.reshape(n, params.kmer_bytes, 4)
    packed = fours[..., 0] << 6 | fours[..., 1] << 4 | fours[..., 2] << 2 | fours[..., 3]
    width = counts.astype("<i8").view(np.uint8).reshape(n, 8)[:, : params.count_bytes]
    return np.concatenate([packed[:, ::-1], width], axis=1).tobytes()


def decode(data: bytes, params: CountParams) -> pa.RecordBatch:
    """kmer, count of whole records."""
    size = params.kmer_bytes
    rows = np.frombuffer(data, np.uint8).reshape(-1, size + params.count_bytes)
    bases = np.ascontiguousarray(_FOUR[rows[:, :size][:, ::-1]].reshape(len(rows), 4 * size)[:, -params.k :])
    counts = np.zeros((len(rows), 8), np.uint8)
    counts[:, : params.count_bytes] = rows[:, size:]
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * params.k)
    kmers = pa.LargeStringArray.from_buffers(len(rows), offsets, pa.py_buffer(bases)).cast(pa.string())
    return pa.RecordBatch.from_arrays([kmers, pa.array(counts.view("<i8").ravel())], schema=SCHEMA)


def read_header(path: str) -> CountParams:
    """The parameters a file (or a folder of them) was written with; raises ValueError if it has no sound header."""
    if files.is_folder(path):
        path = files.listed(path)[0]
    with files.opened(path) as f:
        data = f.read(HEADER.size)
    if len(data) < HEADER.size:
        raise ValueError(f"{path}: the header is cut off")
    k, count_max, filter_min, filter_max = HEADER.unpack(data)
    return CountParams(k=k, count_max=count_max, filter_min=filter_min, filter_max=filter_max)


class Range(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rows_per_task", 2_000_000))

    def partitions(self) -> list[Range]:
        out = []
        for path in files.listed(self.path):
            params = read_header(path)
            n, rest = divmod(files.size(path) - HEADER.size, params.kmer_bytes + params.count_bytes)
            if rest:
                raise ValueError(f"{path}: the last record is cut off")
            out += [Range(path, i, min(self.rows, n - i)) for i in range(0, max(n, 1), self.rows)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        params = read_header(partition.path)
        width = params.kmer_bytes + params.count_bytes
        with files.opened(partition.path) as f:
            f.seek(HEADER.size + partition.first * width)
            left = partition.n
            while left:
                n = min(left, 65_536)
                yield decode(f.read(n * width), params)
                left -= n


@dataclass
class Part(WriterCommitMessage):
    path: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        names = ("k", "count_max", "filter_min", "filter_max")
        self.params = CountParams(**{n: int(options[n]) for n in names if n in options})
        self.path = options["path"].rstrip("/")
        self.layout = options.get("layout", "file")
        if self.layout not in ("file", "parts"):
            raise ValueError("layout must be file or parts")
        if files.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        p = self.params
        self.header = HEADER.pack(p.k, p.count_max, p.filter_min, p.filter_max)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        out, path = None, f"{self.parts}/{uuid.uuid4().hex}.kmers"
        try:
            for batch in batches:
                if out is None:
                    out = files.created(path)
                    if self.layout == "parts":
                        out.write(self.header)
                kmers, counts = batch.column("kmer"), batch.column("count")
                for at in range(0, len(kmers), 65_536):
                    out.write(encode(kmers.slice(at, 65_536), counts.slice(at, 65_536).to_numpy(), self.params))
        finally:
            if out is not None:
                out.close()
        return Part(path if out is not None else None)

    def commit(self, messages) -> None:
        made = [m.path for m in messages if m is not None and m.path]
        if self.layout == "parts":
            # Only what tasks report counts: a task that ran twice leaves a file that goes.
            whole = f"{self.parts}.whole"
            for i, path in enumerate(made):
                files.renamed(path, f"{whole}/part-{i:06d}.kmers")
            if not made:
                with files.created(f"{whole}/part-000000.kmers") as out:
                    out.write(self.header)
        else:
            whole = f"{self.parts}.whole"
            with files.created(whole) as out:
                out.write(self.header)
                for path in made:
                    with files.opened(path) as part:
                        while data := part.read(1 << 20):
                            out.write(data)
        files.moved(whole, self.path)
        files.dropped(self.parts)

    def abort(self, messages) -> None:
        files.dropped(self.parts)


class KmerbinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmerbin"

    def schema(self) -> str:
        return "kmer string, count long"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def write_result(result: DataFrame, path: str, params: CountParams, overwrite: bool = False, layout: str = "file") -> None:
    """Write kmer, count as one binary file, or (layout parts) as a folder of them, where all executors see it."""
    result.sparkSession.dataSource.register(KmerbinSource)
    writer = result.select("kmer", "count").write.format("kmerbin").mode("overwrite" if overwrite else "append").option("layout", layout)
    for name in ("k", "count_max", "filter_min", "filter_max"):
        writer = writer.option(name, getattr(params, name))
    writer.save(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """kmer, count of a binary file or a folder of them."""
    spark.dataSource.register(KmerbinSource)
    return spark.read.format("kmerbin").load(path)
