"""Token-id output: length-delimited binary records with masked checksums and an offset index.

One record (all integers little-endian)::

    u64  length of the payload
    u32  masked CRC-32 of those eight bytes
    ...  payload: u8 flags, i64 doc_id, then the ids
    u32  masked CRC-32 of the payload
    u8   0x0A, the end of the record

Flag 1: ids are u16 (every id of the document is below 65,536), else u32.
Flag 2: doc_id is null.  The mask is ``rotate_right(crc, 15) + 0xA282EAD8``, so
that a checksum over data that holds checksums stays sound.

Records are in ascending doc_id order (null first) within a file, and files in
the order of the numbers in their names.  Beside ``records/`` stands ``index/``, a Parquet
table with a row per record (file, place, size, counts): a shuffled reader
picks rows of the index, opens only the files that hold them and decodes only
their byte ranges.

Files are written and read by Spark's own text and binaryFile formats, so any
store that Spark reaches serves, a lost task is run again, and only committed
files are seen.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, encoder

#: Fixed value of the format.
MASK_DELTA = 0xA282EAD8
TARGET_BYTES = 32 << 20

_HEAD = struct.Struct("<QI")
_LEAD = struct.Struct("<Bq")
INDEX = (
    "doc_id long, file string, byte_start long, byte_size long, start_in_file long, "
    "n_tokens long, ids_crc32 long"
)


class CorruptRecord(ValueError):
    """A checksum or a length of a record file doesn't fit."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record of ids given as little-endian u32."""
    flags, values = 0, np.frombuffer(ids, dtype="<u4")
    if not len(values) or values.max() < 1 << 16:
        flags, ids = 1, values.astype("<u2").tobytes()
    payload = _LEAD.pack(flags | 2 * (doc_id is None), doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload)), b"\n"))


def unframe(content: bytes, at: int = 0) -> Iterator[tuple[int | None, bytes, int, int]]:
    """(doc_id, ids as u32 bytes, place, size) of each record of a file; raises CorruptRecord."""
    view = memoryview(content)
    while at < len(view):
        if len(view) - at < _HEAD.size:
            raise CorruptRecord(f"the head of a record at byte {at} is cut off")
        length, check = _HEAD.unpack_from(view, at)
        if masked_crc(view[at : at + 8]) != check:
            raise CorruptRecord(f"the length at byte {at} fails its checksum")
        end = at + _HEAD.size + length
        if end + 5 > len(view):
            raise CorruptRecord(f"the record at byte {at} is cut off")
        payload = view[at + _HEAD.size : end]
        if masked_crc(payload) != int.from_bytes(view[end : end + 4], "little") or view[end + 4] != 10:
            raise CorruptRecord(f"the payload at byte {at} fails its checksum")
        flags, doc_id = _LEAD.unpack_from(payload)
        ids = payload[_LEAD.size :]
        ids = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if flags & 1 else bytes(ids)
        yield None if flags & 2 else doc_id, ids, at, end + 5 - at
        at = end + 5


def _frames(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder.opened(tokenizer).encode_many
        for batch in batches:
            for keys, texts in encoder.slices(batch.column(0), batch.column(1)):
                rows = [frame(k, ids + encoder.END)[:-1] for k, ids in zip(keys, encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name, rows, before = path.as_py().rsplit("/", 1)[-1], [], 0
            for doc_id, ids, at, size in unframe(content.as_buffer()):
                rows.append((doc_id, name, at, size, before, len(ids) // 4, zlib.crc32(ids)))
                before += len(ids) // 4
            if rows:
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    paths = f"{path}/records" if names is None else [f"{path}/records/{n}" for n in names]
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).select("path", "content")


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", target_bytes: int = TARGET_BYTES) -> None:
    """Encode whole texts and write ``path/records`` and ``path/index``.

    A null text counts as empty; each document ends with id 0.  Repeated and
    null doc_ids keep their rows.  Other columns are ignored.  A file gets
    about target_bytes of text, so the number of files follows the input.  Rows
    that agree in doc_id are dealt out by their texts and places, so that very many
    of them (null ids) fill several files; their order among themselves is not defined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // target_bytes))
    ordered = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    framed = ordered.mapInArrow(_frames(tokenizer or encoder.default_tokenizer()), "frame binary")
    # A string column is written byte for byte; the line end is a record's last byte.
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    build_index(spark, path)


def build_index(spark: SparkSession, path: str) -> None:
    """Read all record files, check every checksum, and write ``path/index``."""
    _files(spark, path).mapInArrow(_scan, INDEX).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, with `start`: the ids of all records before it.

    Only one row per file is summed in order; the rest is arithmetic.
    """
    rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    from pyspark.sql import Window as W

    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids_in_file"))
    # By number: part-100000 comes behind part-99999.
    before = W.orderBy(F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), "file").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("file", F.coalesce(F.sum("ids_in_file").over(before), F.lit(0)).alias("ids_before"))
    return rows.join(sums, "file").withColumn("start", F.col("ids_before") + F.col("start_in_file")).drop("ids_before")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = [], []
        for content in batch.column(0):
            for doc_id, data, _, _ in unframe(content.as_buffer()):
                keys.append(doc_id)
                ids.append(np.frombuffer(data, dtype="<u4").astype("int64"))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files: doc_id, ids (with the end id)."""
    return _files(spark, path).select("content").mapInArrow(_decode, "doc_id long, ids array<long>")


def read_selected(spark: SparkSession, path: str, selected: DataFrame, most_named: int = 10_000) -> DataFrame:
    """The records of chosen rows of the index (a sample, a shuffled epoch's slice): doc_id, ids.

    Only files that hold chosen records are opened (up to most_named of them;
    beyond, the folder is listed), and of those only the chosen byte ranges are decoded.
    """
    picked = selected.select("file", "byte_start", "byte_size")
    names = [r[0] for r in picked.select("file").distinct().limit(most_named + 1).collect()]
    if not names:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    data = _files(spark, path, names if len(names) <= most_named else None)
    data = data.withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).join(picked, "file")
    piece = F.expr("substring(content, int(byte_start) + 1, int(byte_size))")
    return data.select(piece.alias("content")).mapInArrow(_decode, "doc_id long, ids array<long>")
