"""Removal of passages that repeat anywhere in the corpus, over a log-structured fingerprint index.

A window is ``width`` consecutive words.  Two equal windows hold equal
``grain``-word pieces, and both pick the piece with the smallest hash, so the
hashes of the pieces that some window picks (about one in fourteen) find every
repeat.  These *anchors* are what the index holds:

* each batch of texts becomes an immutable run, sorted by anchor hash;
* the run is merge-joined with the runs before it, which gives the anchors that
  occur a second time, in old texts and new;
* runs are compacted into one once there are more than ``fanout``.

A manifest names the runs in force; an index that is opened again goes on from
there, so that a new batch is held against all history.

Windows around such anchors are then verified: they repeat only if two hashes
of 64 bits over all their words, from two hashes of each word, agree.  Texts that
are exact copies are one row throughout, and counts are combined before every
shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .texts import Texts, text_id, text_rest, whole

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: id: the first 64 bits of a text's md5.
RUN = "hash long, id long"


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        size = max(4096, 1 << (size - 1).bit_length())
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = both[0], both[1]
    up, down = _POWERS[base]
    return up[:size], down[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash, so that all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash for each run of width word hashes, by differences of one running sum."""
    up, down = _powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * down[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * up[: len(words) - width + 1])


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) over each width neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = fold(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return fold(x[:-rest], x[rest:]) if rest else x


def word_hashes(text: bytes, seed: int = 0) -> np.ndarray:
    words = text.split()  # of bytes: the six ASCII spaces
    if seed:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def picks(words: np.ndarray, width: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, anchors): the smallest piece hash of each window, and the hash at each place that a window picks."""
    pieces = window_hashes(words, grain, _BASES[0])
    least = _slide(pieces, width - grain + 1, np.minimum)
    reach = width - grain
    none = np.zeros(reach, np.uint64)
    most = _slide(np.concatenate([none, least, none]), reach + 1, np.maximum)
    return least, pieces[pieces == most]


def _anchors(width: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = [], []
            for row, packed in enumerate(batch.column(1)):
                words = word_hashes(whole(packed))
                if len(words) >= width:
                    found = picks(words, width, grain)[1]
                    hashes.append(found)
                    rows.append(np.full(len(found), row))
            if hashes:
                ids = batch.column(0).to_numpy()[np.concatenate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(ids)], ["hash", "id"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of anchor hashes in a shared folder.

    With a path the index that lies there, if there is one, is opened.  A run is in
    force once a manifest names it: the one of the highest number counts, and what
    it doesn't name is left from an addition that failed, or from before a compaction.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = path or common.scratch_path(spark, "fingerprints")
        self.number, self.runs = 0, []
        target = self._at(self.path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(target):
            names = [s.getPath().getName() for s in files.listStatus(target)]
            self.number = max((int(n.split("-")[1]) for n in names if n.startswith("manifest-")), default=0)
        if self.number:
            self.runs = [f"{self.path}/{r[0]}" for r in spark.read.text(f"{self.path}/manifest-{self.number}").collect()]

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self, runs: list[str]) -> None:
        """Put a manifest of these runs in force: written beside its place, then moved there at once."""
        draft, place = self._at(f"{self.path}/_draft-{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest-{self.number + 1}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(draft)
        out.write(bytearray("".join(r.rsplit("/", 1)[1] + "\n" for r in runs), "ascii"))
        out.close()
        if files.exists(place) or not files.rename(draft, place):
            raise RuntimeError(f"{place.toString()} is there already: another writer is at work")
        self.number, self.runs = self.number + 1, runs

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # The texts of a very common hash are dealt out too.
        rows.repartition(parts, "hash", F.pmod("id", F.lit(256))).sortWithinPartitions("hash").write.parquet(path)
        return path

    def add_batch(self, anchors: DataFrame) -> DataFrame:
        """Write a run and merge-join it with the runs before.  Returns the rows
        (hash, id), of this batch and earlier ones, whose hash is no longer alone."""
        new = self._write(anchors)
        rows = self._read([new])
        counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
        if not self.runs:
            again, both = counts.where("n > 1"), rows
        else:
            old = self._read(self.runs)
            before = old.groupBy("hash").agg(F.count("*").alias("m"))
            again = counts.join(before, "hash", "left").where("n > 1 or m is not null").select("hash", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
            both = rows.union(old)
        # Written, since compacting drops the runs that it is made of.
        suspects = common.stored(common.having(both, again, ["hash"]), "suspects")
        self._commit([*self.runs, new])
        common.free_shuffles(self.spark)
        return suspects

    def compact(self) -> None:
        """Merge the runs into one.  Old runs go once the new one stands."""
        if len(self.runs) > self.fanout:
            old, merged = self.runs, self._write(self._read(self.runs))
            self._commit([merged])
            for path in old:
                common.drop_path(self.spark, path)
            common.free_shuffles(self.spark)


def _windows(width: int, grain: int, hot: np.ndarray, wants_hot: bool):
    """first, second (hashes of a window's words), id, and in one number the rest of the text's md5 and the
    place: of windows whose piece is wanted, and (wants_hot) is or is not among the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rests, copies = (batch.column(i).to_numpy() for i in (0, 1, 4))
            for row in range(batch.num_rows):
                text = whole(batch.column(2)[row])
                words = word_hashes(text)
                wanted = batch.column(3)[row].values.to_numpy().view(np.uint64)
                wanted = wanted[np.isin(wanted, hot) == wants_hot]
                if len(words) < width or not len(wanted):
                    continue
                least = picks(words, width, grain)[0]
                at = np.flatnonzero(np.isin(least, wanted))
                if not len(at):
                    continue
                first = window_hashes(words, width, _BASES[0])[at]
                second = window_hashes(word_hashes(text, 1), width, _BASES[1])[at]
                # Texts that have copies are only counted.
                places = (int(rests[row]) << 32) + at if copies[row] == 1 else np.full(len(at), -1)
                arrays = [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.full(len(at), ids[row])), pa.array(places)]
                yield pa.RecordBatch.from_arrays(arrays, ["first", "second", "id", "place"])

    return run


def _settled(first: np.ndarray, second: np.ndarray):
    """id, rest and places: where a text holds the given windows, those of a text in one row for each batch it comes in."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    most = int(np.unique(first, return_counts=True)[1].max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            place, hit = np.searchsorted(first, columns[0]), np.zeros(batch.num_rows, bool)
            for step in range(most):
                near = np.minimum(place + step, len(first) - 1)
                hit |= (first[near] == columns[0]) & (second[near] == columns[1])
            at = np.flatnonzero(hit & (columns[3] >= 0))
            if not len(at):
                continue
            ids, places = columns[2][at], columns[3][at]
            order = np.lexsort((places, ids))
            ids, rests, places = ids[order], places[order] >> 32, (places[order] & 0xFFFFFFFF).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (rests[1:] != rests[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(rests[starts]), lists], ["id", "rest", "places"])

    return run


def _removed(width: int):
    names = ["text_key", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, packed, copies, places in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                words = whole(packed).split()
                n = len(words)
                if n >= width and copies > 1:
                    kept = []
                elif places:
                    change = np.zeros(n + 1, np.int32)
                    starts = np.array(places)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + width, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                else:
                    kept = words
                joined = b" ".join(kept)
                rows.append((key, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def remove_repeats(docs: DataFrame, width: int = 35, grain: int = 8, batches: int = 3, fanout: int = 2, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, history: str | None = None, hot_rows: int = 2048, most_hot: int = 10_000) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, the text that stays, on request).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes if a window over it
    has the same words as a window that starts anywhere else, in any row,
    the same one included.  Null and blank texts have no words; texts shorter
    than the window lose nothing.  Repeated doc_ids are separate documents.
    batches: in how many parts the texts enter the index, which merges its runs
    once there are more than fanout.

    hot_rows: pieces that stand in more places, the most_hot most common ones, go a way of their own,
    and so do their windows.

    history: a shared folder that keeps the index and the distinct texts of all calls so
    far.  A window then also repeats if a document of an earlier call holds it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    all_texts = Texts(docs, id_column, text_column)
    texts = all_texts.table.select("text_key", "packed", "copies")

    index = FingerprintIndex(spark, history and f"{history}/index", fanout)
    earlier = spark.read.schema(texts.schema).option("recursiveFileLookup", "true").parquet(f"{history}/texts") if history and index.runs else None
    suspects = None
    for batch in range(batches):
        some = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(batches)) == batch)
        anchors = some.select(text_id("text_key").alias("id"), "packed").mapInArrow(_anchors(width, grain), RUN)
        found = index.add_batch(anchors)
        suspects = found if suspects is None else suspects.union(found)
        index.compact()
    # Pieces that stand in very many places; at most most_hot of them.
    often = suspects.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = np.array([r[0] for r in often.orderBy(F.desc("n"), "hash").limit(most_hot).collect()], np.int64)
    listed = F.broadcast(spark.createDataFrame([(h, 1) for h in hot.tolist()], "hash long, hot int"))
    wanted = suspects.join(listed, "hash", "left").groupBy("id").agg(F.collect_set("hash").alias("hashes"), F.max("hot").alias("hot"))
    keys = texts.select("text_key", text_id("text_key").alias("id"), text_rest("text_key").alias("rest"))
    chosen = common.stored(wanted.join(keys, "id").select("text_key", "id", "rest", "hashes", "hot"), "wanted")
    near = texts.join(chosen, "text_key").select("id", "rest", "packed", "hashes", "copies", "hot")
    if earlier is not None:  # counted, not judged
        old = earlier.withColumn("id", text_id("text_key")).join(wanted, "id")
        near = near.union(old.select("id", F.lit(0).cast("long"), "packed", "hashes", F.lit(2).cast("long"), "hot"))
    shape = "first long, second long, id long, place long"
    # Windows of ordinary pieces are counted where they meet; those of hot ones are combined before they
    # do. The most common of them are then known to every task, which gives a row for a text and not for
    # each place; all others meet their counts in a join.
    cold = near.drop("hot").mapInArrow(_windows(width, grain, hot.view(np.uint64), False), shape)
    met = F.count("*").over(W.partitionBy("first", "second"))
    again = cold.withColumn("n", met).where("n > 1 and place >= 0").select("id", "place")
    settled = None
    if len(hot):
        on = ["first", "second"]
        common_ones = common.stored(near.where("hot = 1").drop("hot").mapInArrow(_windows(width, grain, hot.view(np.uint64), True), shape), "windows")
        twice = common.stored(common_ones.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "twice")
        known = twice.where(F.col("n") > hot_rows).orderBy(F.desc("n"), *on).limit(most_hot).collect()
        pairs = np.array([r[:2] for r in known], np.int64).reshape(-1, 2)
        settled = common_ones.mapInArrow(_settled(pairs[:, 0], pairs[:, 1]), "id long, rest long, places array<int>")
        others = common_ones.where("place >= 0").join(F.broadcast(spark.createDataFrame(pairs.tolist(), "first long, second long")), on, "left_anti")
        again = again.union(others.join(twice.select(*on), on, "left_semi").select("id", "place"))
    rest, at = F.shiftrightunsigned("place", 32).alias("rest"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at")
    places = again.select("id", rest, at, F.lit(None).cast("array<int>").alias("more"))
    if settled is not None:
        places = places.union(settled.select("id", "rest", F.lit(None).cast("int").alias("at"), F.col("places").alias("more")))
    places = places.groupBy("id", "rest").agg(F.concat(F.collect_set("at"), F.flatten(F.collect_list("more"))).alias("places"))
    places = common.stored(places.join(chosen.select("text_key", "id", "rest"), ["id", "rest"]).select("text_key", "places"), "places")
    common.free_shuffles(spark)
    judged = texts.join(places, "text_key", "left").select("text_key", "packed", "copies", "places")
    judged = judged.mapInArrow(_removed(width), "text_key binary, n_words long, n_removed long, kept_sha256 string, kept string")
    if not with_text:
        judged = judged.drop("kept")
    judged = common.stored(judged, "judged")
    if history:
        texts.write.mode("append").parquet(f"{history}/texts/{uuid.uuid4().hex}")
    else:
        common.drop_path(spark, index.path)
    all_texts.drop()
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    return rows.join(judged, "text_key").select(*names)
