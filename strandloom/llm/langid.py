"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point
alone.  A letter n-gram is bound from its letters' vectors, each permuted (here
rotated) by its place, and multiplied.  A text is the bundle (sum) of its
n-grams, a language the bundle of its texts, and the nearest language by cosine
is the answer.

Bundling is linear, so training only counts: a language's bundle is the sum of
its n-gram vectors by their weight, and a few numbers per n-gram and partition
are all that leaves a task.  Tasks then bundle the n-grams, in integers, so that
the sums don't depend on any order; the driver gets one vector per language.  Scoring bundles a batch of texts as one product of
their n-gram counts with the n-grams' vectors.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([code, 20_011]).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


class Vectors:
    """n-gram vectors, bound from letter vectors; at most `entries` letter vectors are kept."""

    def __init__(self, dimensions: int, n: int, entries: int = 4096):
        self.dimensions, self.n, self.entries = dimensions, n, entries
        self._held: OrderedDict[int, list[np.ndarray]] = OrderedDict()

    def _rotations(self, code: int) -> list[np.ndarray]:
        if code not in self._held:
            if len(self._held) >= self.entries:
                self._held.popitem(last=False)
            v = letter_vector(code, self.dimensions)
            self._held[code] = [np.roll(v, place) for place in range(self.n)]
        return self._held[code]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """grams: (rows, n) code points.  Returns (rows, dimensions) of +1 and -1 as float32."""
        codes, place = np.unique(grams, return_inverse=True)
        place = place.reshape(grams.shape)
        tables = np.array([self._rotations(int(c)) for c in codes], np.int8).reshape(len(codes), self.n, self.dimensions)
        out = tables[place[:, 0], 0]
        for i in range(1, self.n):
            out = out * tables[place[:, i], i]
        return out.astype(np.float32)


def grams_of(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, row, which): distinct n-grams (n of 2 or more) as (k, n) code points,
    and for each occurrence its text and its n-gram.  Letters in lower case;
    whatever lies between words is one space, which also stands at both ends."""
    framed = [f"\n{(t or '').lower()}\n" for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(framed)), [len(t) for t in framed])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])  # of other signs the first in a run
    keep[:1] = True
    shown, row = np.where(letter, codes, 32)[keep], row[keep]
    if len(shown) < n:
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flags = np.zeros(int(shown.max()) + 1, bool)
    flags[shown] = True
    alphabet = np.flatnonzero(flags)
    base, small = len(alphabet), (np.cumsum(flags) - 1)[shown]
    window = np.zeros(len(small) - n + 1, np.int64)
    for i in range(n):
        window = window * base + small[i : len(small) - n + 1 + i]
    inside = row[: len(window)] == row[n - 1 :]
    window, row = window[inside], row[: len(window)][inside]
    if base**n <= 1 << 22:
        flags = np.zeros(base**n, bool)
        flags[window] = True
        found, which = np.flatnonzero(flags), (np.cumsum(flags) - 1)[window]
    else:
        found, which = np.unique(window, return_inverse=True)
    parts, rest = [], found
    for _ in range(n):
        parts.append(alphabet[rest % base])
        rest = rest // base
    return np.stack(parts[::-1], axis=1), row, which


def _slices(texts: list[str | None], most: int = 1 << 19, rows: int = 512) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= most or at + 1 - start >= rows:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Weights are counted in such parts of one.
UNIT = 1 << 16


def _counts(n: int, entries: int = 500_000):
    """Per task: the weight of each n-gram in each language, every text with weight UNIT.  At most
    about `entries` of them are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, float] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _slices(texts):
                grams, row, which = grams_of(texts[i:j], n)
                if not len(grams):
                    continue
                names, lang = np.unique(np.array(langs[i:j]), return_inverse=True)
                sizes = np.bincount(row, minlength=j - i)
                weights = np.bincount(lang[row] * len(grams) + which, weights=1.0 / sizes[row], minlength=len(names) * len(grams))
                for at in np.flatnonzero(weights).tolist():
                    key = (names[at // len(grams)], *grams[at % len(grams)].tolist())
                    total[key] = total.get(key, 0.0) + weights[at]
                if len(total) >= entries:
                    yield made(total)
                    total = {}
        if total:
            yield made(total)

    def made(total: dict[tuple, float]) -> pa.RecordBatch:
        keys = list(total)
        weights = np.rint(np.array(list(total.values())) * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([str(k[0]) for k in keys]), pa.array([list(k[1:]) for k in keys], pa.list_(pa.int32())), pa.array(weights)], ["lang", "gram", "weight"])

    return run


def _bundles(dimensions: int, n: int):
    """Per task: lang, dimension, value of the bundle of its rows (lang, gram, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, found = Vectors(dimensions, n), {}
        for batch in batches:
            langs, weights = np.array(batch.column(0).to_pylist()), batch.column(2).to_numpy()
            grams = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, n)
            for at in range(0, len(langs), 4096):
                some = slice(at, at + 4096)
                bound = vectors.bind(grams[some]).astype(np.float64)
                for lang in np.unique(langs[some]).tolist():
                    # Whole numbers far below 2**53, so the sum is exact.
                    own = np.rint(np.where(langs[some] == lang, weights[some], 0) @ bound).astype(np.int64)
                    found[lang] = found.get(lang, 0) + own
        for lang, bundle in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(bundle)], ["lang", "at", "value"])

    return run


class Profiles:
    """The language prototypes: unit vectors, one row per language."""

    def __init__(self, langs: list[str], prototypes: np.ndarray, n: int):
        self.langs, self.prototypes, self.n = langs, prototypes, n

    @property
    def dimensions(self) -> int:
        return self.prototypes.shape[1]


def train(rows: DataFrame, n: int = 3, dimensions: int = 1024, text_column: str = "text", lang_column: str = "lang") -> Profiles:
    """Prototypes from all rows with a text and a language.

    Only sums per language and n-gram are shuffled, and then those per language and dimension.
    """
    pairs = rows.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    pairs = pairs.select(F.col(text_column).cast("string"), F.col(lang_column).cast("string"))
    sums = pairs.mapInArrow(_counts(n), "lang string, gram array<int>, weight long").groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))
    parts = sums.mapInArrow(_bundles(dimensions, n), "lang string, at int, value long")
    found = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()  # languages times dimensions
    bundles = {r["lang"]: np.zeros(dimensions) for r in found}
    for r in found:
        bundles[r["lang"]][r["at"]] = r["value"]
    langs = sorted(bundles)
    prototypes = np.array([bundles[x] / max(np.linalg.norm(bundles[x]), 1e-12) for x in langs], np.float32).reshape(len(langs), dimensions)
    return Profiles(langs, prototypes, n)


def _predict(profiles: Profiles, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(profiles.dimensions, profiles.n)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            langs, scores = [], []
            for i, j in _slices(texts):
                grams, row, which = grams_of(texts[i:j], profiles.n)
                bundles = np.zeros((j - i, profiles.dimensions), np.float32)
                for at in range(0, len(grams), 4096):  # blocks of n-grams bound the memory
                    some = (which >= at) & (which < at + 4096)
                    size = min(4096, len(grams) - at)
                    counts = np.bincount(row[some] * size + which[some] - at, minlength=(j - i) * size).reshape(j - i, size)
                    bundles += counts.astype(np.float32) @ vectors.bind(grams[at : at + 4096])
                norms = np.linalg.norm(bundles, axis=1)
                cosines = bundles @ profiles.prototypes.T / np.maximum(norms, 1e-9)[:, None]
                lettered = np.bincount(row, minlength=j - i) > 0
                for k in range(j - i):
                    if not lettered[k] or not profiles.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(np.argmax(cosines[k]))
                        langs.append(profiles.langs[best])
                        scores.append(float(min(1.0, max(0.0, cosines[k, best]))))
            kept = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return run


def predict(docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """A row per document: doc_id, the columns of keep, lang_pred, score (the cosine, 0 to 1).

    A null text and one without a letter give `und` and score 0; so does every
    text if nothing was learnt.  Repeated ids keep their rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *(keep or []), F.col(text_column).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(profiles, len(fields), schema.names), schema)
