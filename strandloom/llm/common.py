"""What the operators share: reading tables, scratch tables and typed empties."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition here: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch.  Texts are some kilobytes, so a batch is some megabytes.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows: what a task holds outside
    its heap, in the JVM and in Python, grows with them."""
    now = int(spark.conf.get(_BATCH_KEY))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset
    (tests, a laptop) and the master is local does a temporary folder stand in.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not context.master.startswith("local["):
        if found := context.getCheckpointDir():
            return found.rstrip("/")
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _FALLBACK[context.applicationId]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/strandloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, partitions: int | None = None) -> DataFrame:
    """df as a written table: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by stored(), once nothing reads it any more."""
    files = df.inputFiles()
    if files and "/strandloom/" in files[0]:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries: its cleaner does so once the driver's
    collector finds that nothing refers to them.  Worth a call after a large table is written."""
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    """Give back to the system what earlier tasks of a worker process have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def begin_stage(spark: SparkSession) -> None:
    """Bound Arrow batches, and let go of what earlier stages left with the driver."""
    bound_batches(spark)
    free_shuffles(spark)
    release_memory()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int, flush_rows: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of about flush_rows rows at a time.  Rows come sorted by the first `keys` columns;
    rows that agree in them are never parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) >= flush_rows:
            last = np.ones(len(held[0]), bool)
            for c in held[:keys]:
                last &= c == c[-1]
            if cut := int(np.argmax(last)):  # rows are sorted: the last run is at the end
                yield [c[:cut] for c in held]
                held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def having(rows: DataFrame, keys: DataFrame, on: list[str], large: int = 2048, most: int = 10_000) -> DataFrame:
    """The rows whose columns `on` are among keys (on, and n: how many rows a key has).
    The `most` most common keys are looked up without a shuffle, so they burden no task."""
    hot = F.broadcast(keys.where(F.col("n") > large).orderBy(F.desc("n"), *on).limit(most).select(*on))
    return rows.join(hot, on, "left_semi").union(rows.join(hot, on, "left_anti").join(keys.select(*on), on, "left_semi"))


def crc_mod(doc_id: str, mod: int):
    """crc32 of an id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def words_of(text) -> object:
    """Column: array of the words of a text, `[^\\x20\\x09-\\x0D]+`; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")
