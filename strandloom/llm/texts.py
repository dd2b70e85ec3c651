"""Distinct texts, packed and bucketed, so that a text is shuffled once and joined often."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, packed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        *kept, texts = batch.columns
        values = pa.array([None if t is None else pack(t.encode()) for t in texts.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*kept, values], batch.schema.names)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, as it was before it was packed."""
    for batch in batches:
        *kept, texts = batch.columns
        yield pa.RecordBatch.from_arrays([*kept, pa.array(map(unpack, texts), pa.string())], batch.schema.names)


def unpack(packed: pa.BinaryScalar) -> str | None:
    return zstandard.ZstdDecompressor().decompress(packed.as_py()).decode() if packed.is_valid else None


def whole(packed: pa.BinaryScalar) -> bytes:
    """A packed text in UTF-8; nothing for null."""
    return zstandard.ZstdDecompressor().decompress(packed.as_py()) if packed.is_valid else b""


def text_id(text_key: str) -> Column:
    """The first 64 bits of a text's md5."""
    return F.conv(F.hex(F.substring(text_key, 1, 8)), 16, -10).cast("long")


def text_rest(text_key: str) -> Column:
    """The next 31 bits of a text's md5."""
    return F.conv(F.hex(F.substring(text_key, 9, 4)), 16, 10).cast("long").bitwiseAND(F.lit((1 << 31) - 1))


class Texts:
    """Distinct texts in buckets of their md5: text_key, first_id, row (the columns of keep in the first row), packed, copies."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str, keep: list[Column] | None = None):
        self.spark = spark = docs.sparkSession
        text = F.col(text_column).cast("string")
        rows = docs.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), F.col(id_column).cast("long").alias("first_id"), F.struct(F.lit(0).alias("none"), *(keep or [])).alias("row"), text.alias("packed"))
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("packed", T.BinaryType())])
        rows = rows.mapInArrow(packed, schema)
        order = F.struct(F.col("first_id").isNull(), "first_id", F.col("packed").isNull())
        first = F.min_by(F.struct("first_id", "row", "packed"), order).alias("first")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"strandloom_{uuid.uuid4().hex}", common.scratch_path(spark, "texts")
        # The aggregation has dealt the rows out by the key already, into as many parts as there are buckets.
        rows.groupBy("text_key").agg(first, F.count("*").alias("copies")).select("text_key", "first.*", "copies").write.bucketBy(self.parts, "text_key").option("path", self.path).saveAsTable(self.name)
        common.free_shuffles(spark)
        self.table = spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        common.drop_path(self.spark, self.path)
