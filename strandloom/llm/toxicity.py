"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Fitting takes a sample of labelled rows with a fixed bound, by the hash of
their ids and evenly per label.  Words that go with the label (chi-squared)
form the vocabulary; their document frequencies are counted over all
documents.  The examples' vectors form an inverted index whose lists are cut
into blocks of examples, each with its largest weight.  A search bounds every
block's cosine from those maxima, scores blocks exactly in the order of their
bounds, and stops where no further block can reach the k best: the result is
that of a search of all examples.  The neighbours vote with their cosine as the
weight, a logistic curve fitted on left-one-out votes turns votes into scores,
and the neighbours are reported as evidence.

What is broadcast is bounded by ``examples`` and ``terms``, not by the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_GAP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: runs of letters (every sign outside ASCII counts as one)."""
    return (text or "").lower().encode().translate(_GAP).split()


def features_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings of 4 to 8 bytes, marked by a star: stems take many endings.

    The star alone, with which every word begins, is a term as well where another
    term occurs; it sets one hit in a long text apart from many.
    """
    return [word, *(word[:n] + b"*" for n in range(4, min(9, len(word))) if word[n] & 0xC0 != 0x80)]


class Terms:
    """Counts of the vocabulary's terms in a text; what each word stands for is remembered, within a bound."""

    def __init__(self, numbers: dict[bytes, int], entries: int = 100_000):
        self.numbers, self.entries, self._held = numbers, entries, {}

    def __reduce__(self):
        return Terms, (self.numbers, self.entries)

    def count(self, text: str | None) -> dict[int, int]:
        held, found = self._held, Counter()
        if len(held) > self.entries:
            held.clear()
        words = words_of(text)
        for word in words:
            own = held.get(word)
            if own is None:
                own = held[word] = tuple(t for f in features_of(word) if (t := self.numbers.get(f)) is not None)
            if own:
                found.update(own)
        if found and b"*" in self.numbers:
            found[self.numbers[b"*"]] = len(words)
        return found


@dataclass
class Index:
    """Block-max inverted index of unit vectors over term numbers."""

    vectors: list[dict[int, float]]
    block: int = 64
    postings: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    maxima: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        lists: dict[int, list[tuple[int, float]]] = {}
        for row, vector in enumerate(self.vectors):
            for term, weight in vector.items():
                lists.setdefault(term, []).append((row, weight))
        for term, found in lists.items():
            rows, weights = np.array([r for r, _ in found]), np.array([w for _, w in found])
            blocks, starts = np.unique(rows // self.block, return_index=True)
            self.postings[term] = rows, weights
            self.maxima[term] = blocks, np.maximum.reduceat(weights, starts), np.r_[starts, len(rows)]

    def nearest(self, vector: dict[int, float], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest cosine over 0 with a unit vector, ties to the smaller row; not the row `but`."""
        terms = [t for t in vector if t in self.postings]
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = np.zeros(-(-len(self.vectors) // self.block))
        for t in terms:
            blocks, most, _ = self.maxima[t]
            bound[blocks] += vector[t] * most
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        at = 0
        step = 4
        while at < len(order) and bound[order[at]] > 0 and (len(rows) < k or bound[order[at]] >= scores[-1] - 1e-12):
            some = np.sort(order[at : at + step])
            at, step = at + step, step * 2
            place = np.full(len(bound), -1)
            place[some] = np.arange(len(some))
            sums = np.zeros(len(some) * self.block)
            for t in terms:
                blocks, _, starts = self.maxima[t]
                here = np.flatnonzero(place[blocks] >= 0)
                own_rows, weights = self.postings[t]
                if 2 * len(here) > len(blocks):
                    keep = place[own_rows // self.block] >= 0
                    r, w = own_rows[keep], weights[keep]
                else:
                    cuts = [slice(starts[i], starts[i + 1]) for i in here.tolist()]
                    if not cuts:
                        continue
                    r, w = np.concatenate([own_rows[c] for c in cuts]), np.concatenate([weights[c] for c in cuts])
                sums[place[r // self.block] * self.block + r % self.block] += vector[t] * w
            found = np.flatnonzero(sums > 0)
            new = some[found // self.block] * self.block + found % self.block
            keep = new != but
            rows, scores = np.concatenate([rows, new[keep]]), np.concatenate([scores, sums[found][keep]])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
        return rows, np.minimum(scores, 1.0)


@dataclass
class Model:
    terms: Terms
    idf: np.ndarray
    index: Index
    labels: np.ndarray
    ids: np.ndarray
    k: int
    slope: float
    offset: float
    base: float  # the score of a text that shares no term with any example

    def vector(self, text: str | None) -> dict[int, float]:
        return unit(self.terms.count(text), self.idf)

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        return self._score(self.vector(text))

    def _score(self, vector: dict[int, float]) -> tuple[float, np.ndarray, np.ndarray]:
        rows, near = self.index.nearest(vector, self.k) if vector else (np.zeros(0, np.int64), np.zeros(0))
        if not len(rows):
            return self.base, rows, near
        return _logistic(self.slope * vote(near, self.labels[rows]) + self.offset), rows, near


def unit(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    weights = {t: (1 + math.log(n)) * float(idf[t]) for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()} if norm else {}


def vote(near: np.ndarray, labels: np.ndarray) -> float:
    return float((near * labels).sum() / near.sum())


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method."""
    if not len(x):
        return 0.0, 0.0
    beta, design = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts of each label a feature occurs."""
    total: dict[bytes, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            at = label.as_py()
            for feature in {f for w in set(words_of(text.as_py())) for f in features_of(w)}:
                total.setdefault(feature, [0, 0])[at] += 1
    if total:
        b, a = zip(*total.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["feature", "a", "b"])


def _sample_vectors(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [terms.count(x.as_py()) for x in batch.column(2)]
            own = pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["doc_id", "label", "terms", "counts"])

    return run


def _frequencies(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(terms.numbers), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                own = terms.count(text.as_py())
                if own:
                    total[list(own)] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there]), pa.array(np.r_[rows, total[there]])], ["term", "n"])
        common.release_memory()

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = 2000, terms: int = 4096, k: int = 15, least_chi2: float = 15.0, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """labels: the rows to learn from, doc_id and a label of 0 or 1 (others and nulls are ignored).

    examples bounds the sample of labelled rows, half per label; terms the vocabulary.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    picked = [r for label in (0, 1) for r in known.where(F.col("label") == label).orderBy(order, "doc_id").limit(examples // 2).collect()]
    spark = docs.sparkSession
    sample = spark.createDataFrame([tuple(r) for r in picked], "doc_id long, label int")  # at most `examples` rows
    sample = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    counts = sample.select("text", "label").mapInArrow(_sample_words, "feature binary, a long, b long")
    counts = counts.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 3")
    n1, n0 = max(1, sum(r["label"] for r in picked)), max(1, sum(1 - r["label"] for r in picked))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n1 + n0)
    chi2 = n * (a * n0 - b * n1) ** 2 / (n1 * n0 * (a + b) * (n - a - b + 1e-9))
    best = counts.select("feature", chi2.alias("chi2")).where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "feature").limit(terms).collect()
    vocabulary = Terms({bytes(r["feature"]): i for i, r in enumerate(best)} | {b"*": len(best)})

    total = rows.select("text").mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = {r["term"]: r["n"] for r in total.collect()}  # one row per term
    everything = frequency.pop(-1, 0)
    idf = np.array([math.log((1 + everything) / (1 + frequency.get(i, 0))) + 1 for i in range(len(best))] + [1.0])

    found = sorted(sample.mapInArrow(_sample_vectors(vocabulary), "doc_id long, label int, terms array<int>, counts array<int>").collect(), key=lambda r: (r["doc_id"], sorted(zip(r["terms"], r["counts"]))))
    vectors = [unit(dict(zip(r["terms"], r["counts"])), idf) for r in found]
    y = np.array([r["label"] for r in found], float)
    # Each label weighs as in all labelled rows, not as in the sample.
    weight = np.array([share.get(int(v), 0) / max(1, int((y == v).sum())) for v in y]) if len(y) else np.zeros(0)
    if len(y):
        weight *= len(y) / weight.sum()
    index = Index(vectors)
    votes, own, alone = [], [], []
    for i, vector in enumerate(vectors):
        near_rows, near = index.nearest(vector, k, but=i) if vector else (np.zeros(0, np.int64), np.zeros(0))
        if len(near_rows):
            votes.append(vote(near, y[near_rows]))
            own.append(i)
        else:
            alone.append(i)
    slope, offset = _fit_logistic(np.array(votes), y[own] if own else y[:0], weight[own] if own else weight[:0])
    base = float(((weight * y)[alone].sum() + 0.1) / (weight[alone].sum() + 1.0)) if alone else 0.1
    return Model(vocabulary, idf, index, y, np.array([r["doc_id"] for r in found], np.int64), k, slope, offset, base)


def _scored(model: Model, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_memory()
        for batch in batches:
            scores, ids, near = [], [], []
            for text in batch.column(text_at):
                score, rows, cosines = model.score(text.as_py())
                scores.append(score)
                ids.append(model.ids[rows].tolist())
                near.append(cosines.tolist())
            kept = [c for i, c in enumerate(batch.columns) if i != text_at]
            own = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*kept, *own], names)

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """A row per document: doc_id, the columns of keep, score, predicted, and as evidence
    neighbours (doc_ids of the nearest examples) and cosines.

    A null, empty or unknown text gets the share of label 1 among such
    examples.  Repeated ids keep their rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *(keep or []), F.col(text_column).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    own = T._parse_datatype_string("score double, predicted int, neighbours array<long>, cosines array<double>")
    schema = T.StructType([*fields, *own.fields])
    return rows.mapInArrow(_scored(model, len(fields), schema.names), schema)
