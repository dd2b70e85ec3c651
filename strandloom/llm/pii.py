"""Personal data: fixed forms, and candidates that boosted trees accept.

Everything on the main path is a DataFrame expression.  Four fixed forms (email,
ip, card, phone) are always kept.  Two generators with high recall propose
further spans (long keys of letters and digits, and digit groups of any
grouping); each candidate gets features of its format and its context, and
gradient-boosted trees, written out as one SQL expression, score it.  The trees
are fitted on the candidates of all documents: candidates of equal features are
counted on the executors, and the driver fits on the counts,
with labels from rules that the features don't hold: a digit group is positive
where it meets a fixed form, a key where a word for a credential stands before
it.  Scores are calibrated on candidates the trees haven't seen, and the
threshold is the smallest that keeps the wanted precision there.

Positions are code points, the end exclusive.  The patterns start only at the
beginning of a run and never give back what they took, so their time is linear
in the text; they find what the plain forms find, leftmost and without overlap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost, common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key", "number")
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (what a text must contain, pattern)
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    # A chain of digits with single spaces or hyphens; shorter chains can't pass.
    "card": (None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "key": (None, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"),
    "number": (None, r"(?<![0-9])(?<![0-9][\x20().-])(?<![0-9][\x20().-]{2})[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
}
CREDENTIAL = r"(?i)(?:token|secret|passw|pwd|api.?key|auth|bearer|credential)"
FEATURES = ("n", "digits", "letters", "others", "distinct_signs", "digit_share", "plus", "dots", "luhn", "quoted", "assigned", "spaced")
FLAGS = ("plus", "luhn", "quoted", "assigned", "spaced")
_SPAN = "array<struct<start:int,kind:int,stop:int,found:string>>"


def _matches(text: Column, kind: str) -> Column:
    needs, pattern = PATTERNS[kind]
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), all_).otherwise(F.array().cast("array<string>")) if needs else all_


def _spans(text: Column, matches: Column, kind: str) -> Column:
    """Places of the matches: a match begins after the pieces and matches before it."""
    pieces = F.split(text, PATTERNS[kind][1], -1)
    none = F.array().cast(_SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["piece"])
        stop = start + F.char_length(pair["found"])
        one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), pair["found"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("found")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["spans"])).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check."""
    signs = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int")))
    doubled = F.transform(signs, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(span: Column, kind: str) -> Column:
    found = span["found"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(found, r"\."), lambda part: ~part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    n = F.length(_digits(found))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(found))
    return n.between(9, 15)


def _passing(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _passes(s, kind))


def _of_kind(spans: str, number: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == number)


def _with_base(rows: DataFrame) -> DataFrame:
    """Adds m_<kind> (raw matches) and base (the spans of the fixed forms, in order)."""
    for kind in BASE:
        rows = rows.withColumn(f"m_{kind}", _matches(F.col("text"), kind))
    spans = [_passing(_spans(F.col("text"), F.col(f"m_{k}"), k), k) for k in BASE]
    return rows.withColumn("base", F.array_sort(F.concat(*spans))).drop(*(f"m_{k}" for k in BASE))


def _meets(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))


def _features(text: Column, span: Column) -> Column:
    found, before = span["found"], F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))
    digits, letters = F.length(_digits(found)), F.length(F.regexp_replace(found, "[^A-Za-z]", ""))
    n = F.length(found)
    values = {
        "n": n,
        "digits": digits,
        "letters": letters,
        "others": n - digits - letters,
        "distinct_signs": F.size(F.array_distinct(F.split(found, ""))),
        "digit_share": digits / n,
        "plus": F.startswith(found, F.lit("+")),
        "dots": n - F.length(F.replace(found, F.lit("."), F.lit(""))),
        "luhn": _luhn(_digits(found)) & digits.between(12, 19),
        "quoted": before.rlike("[\"'`]$"),
        "assigned": before.rlike("[=:][\\s\"'`]*$"),
        "spaced": before.rlike("(?:^|[\\s\"'`(])$"),
    }
    return F.struct(
        *(span[k].alias(k) for k in ("start", "kind", "stop", "found")),
        before.alias("before"),
        *(F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES),
    )


def _with_candidates(rows: DataFrame) -> DataFrame:
    """Adds candidates: what the generators propose, with features."""
    for kind in ("key", "number"):
        rows = rows.withColumn(f"m_{kind}", _matches(F.col("text"), kind))
    spans = F.concat(*(_spans(F.col("text"), F.col(f"m_{k}"), k) for k in ("key", "number")))
    return rows.withColumn("candidates", F.transform(spans, lambda s: _features(F.col("text"), s))).drop("m_key", "m_number")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def _counted(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """How many candidates there are of each combination of features, and how many of them are positive (n<p>, y<p>), in
    three parts: 0 for the trees, 1 for the curve, 2 for the threshold.  A hash of document and span chooses the part."""
    found = _with_candidates(_with_base(_rows(docs, id_column, text_column)))
    # The outer form keeps the optimizer from a filter that runs every pattern once more.
    found = found.select("base", "doc_id", F.explode_outer("candidates").alias("c")).where("c is not null")
    key = F.col("c.kind") == KINDS.index("key")
    label = F.when(key, F.col("c.before").rlike(CREDENTIAL)).otherwise(_meets(F.col("c"), F.col("base")))
    part = F.greatest(F.pmod(F.xxhash64("doc_id", "c.start", "c.kind", "c.stop", "c.found"), F.lit(4)) - 1, F.lit(0))
    rows = found.select(*(F.col(f"c.{k}") for k in FEATURES), label.alias("label"), part.alias("part"))
    counts = [F.count(F.when(F.col("part") == p, 1)).alias(f"n{p}") for p in range(3)]
    hits = [F.count(F.when((F.col("part") == p) & F.col("label"), 1)).alias(f"y{p}") for p in range(3)]
    return rows.groupBy(*FEATURES).agg(*counts, *hits)


def _rounded(cells: DataFrame, coarse: int) -> DataFrame:
    """The cells with features rounded up to fewer values, added up: counts to multiples of 2**coarse, larger ones to
    eighths of a power of two times that, shares to multiples of 2**coarse sixty-fourths."""

    def up(k: str) -> Column:
        v = F.col(k)
        if k in FLAGS:
            return v
        if k == "digit_share":
            return F.ceil(v * (64 / 2**coarse)) * (2**coarse / 64)
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1.0)))) - 3, F.lit(0)) + coarse)
        return F.ceil(v / step) * step

    sums = [F.sum(f"{k}{p}").alias(f"{k}{p}") for k in "ny" for p in range(3)]
    return cells.select(*(up(k).cast("double").alias(k) for k in FEATURES), *(f"{k}{p}" for k in "ny" for p in range(3))).groupBy(*FEATURES).agg(*sums)


def fit(docs: DataFrame, most_cells: int = 20_000, precision: float = 0.95, id_column: str = "doc_id", text_column: str = "text") -> tuple[boost.Trees, float]:
    """The trees and the threshold, from all candidates of all documents.

    The driver takes one row for each combination of features.  Should there be more than most_cells
    of them, features are rounded up, ever more coarsely, until there aren't: every candidate still counts, and
    a cut of the trees parts the unrounded values as it parts the rounded ones, since it lies at one of these.
    """
    cells = common.stored(_counted(docs, id_column, text_column), "cells")
    table, coarse = cells.limit(most_cells + 1).collect(), 0
    while len(table) > most_cells and coarse < 40:
        table = _rounded(cells, coarse).limit(most_cells + 1).collect()
        coarse += 1
    if len(table) > most_cells:
        raise ValueError(f"the candidates don't fit into {most_cells} cells")
    common.drop_stored(cells)
    table.sort()
    x = np.array([r[: len(FEATURES)] for r in table], float).reshape(-1, len(FEATURES))
    n, y = (np.array([[r[f"{k}{p}"] for p in range(3)] for r in table], float).reshape(-1, 3) for k in "ny")
    cell, part = np.nonzero(n)
    x, n, y = x[cell], n[cell, part], y[cell, part] / n[cell, part]
    model = boost.fit(x, y, [f"c.{k}" for k in FEATURES], weight=n, fold=part + 1)
    held = part == 2  # neither the trees nor the curve have seen them
    return model, boost.threshold(model.probability(x[held]), y[held], precision, n[held])


def find_spans(docs: DataFrame, model: boost.Trees, threshold: float, id_column: str = "doc_id", text_column: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """A row per document: doc_id, text, the columns of keep, base and spans, arrays of
    struct<start, kind, stop, found> in order; kind numbers KINDS.

    spans holds the base spans and the candidates that the trees accept: keys that
    lie in no base span, and numbers that none meets.  A null text is empty and has none.  Repeated ids keep
    their rows.  No shuffle and no Python on the executors.
    """
    rows = docs.select(*(keep or []), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = _with_candidates(_with_base(rows))
    accepted = F.expr(f"filter(candidates, c -> {model.sql()} >= {threshold!r}D)")
    rows = rows.withColumn("accepted", F.when(F.size("candidates") > 0, accepted).otherwise(F.array().cast(rows.schema["candidates"].dataType)))
    inside = lambda c: F.exists(F.col("base"), lambda b: (b["start"] <= c["start"]) & (c["stop"] <= b["stop"]))
    key = KINDS.index("key")
    new = F.filter("accepted", lambda c: F.when(c["kind"] == key, ~inside(c)).otherwise(~_meets(c, F.col("base"))))
    # Of two accepted candidates that meet, the one that begins first stays, then the longer.
    new = F.filter(new, lambda c: ~F.exists(new, lambda o: (o["start"] < c["stop"]) & (c["start"] < o["stop"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["stop"] > c["stop"])))))
    new = F.transform(new, lambda c: F.struct(*(c[k].alias(k) for k in ("start", "kind", "stop", "found"))))
    rows = rows.withColumn("new", new)
    return rows.withColumn("spans", F.array_sort(F.concat("base", "new"))).drop("candidates", "accepted", "new")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with <kind> in place of each span; of spans that overlap, the part not yet replaced goes too."""
    names = F.array(*map(F.lit, KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">"))
        fresh = s["start"] >= acc["at"]
        parts = F.when(fresh, F.concat(acc["parts"], F.array(kept, mark))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), parts.alias("parts"))

    whole = F.aggregate(spans, zero, step, lambda acc: F.concat_ws("", acc["parts"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the fixed forms, base_sha256 and spans (text)."""
    counts = [F.size(_of_kind("base", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
