"""Benchmark decontamination with DataFrame expressions only.

A document is contaminated by an item where one of its item-sized windows is
similar to the item: weighted Jaccard of five-word shingles, with their counts
as weights, of at least ``similarity``.

* A similarity above zero takes a shared shingle, so every shingle of an item
  found in a document fixes a window: the one in which that shingle has the
  place it has in the item.
* Windows get a SimHash.  Its bits are cut into ``radius + 1`` blocks; a window
  is looked up block by block in the item's blocks, which misses no fingerprint
  within the radius, and the distance is then taken whole.
* What remains is measured exactly.

The shingles of the benchmark are looked up inside the scan of the documents,
so whole texts are read once and only windows are shuffled.  Their number is
measured first; beyond ``most_literals`` a join does the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5


def words(text: Column) -> Column:
    """Words without case and punctuation: runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _shingles(hashes: str, size: int) -> Column:
    """A hash for each run of size words, from the words' hashes."""
    h = F.col(hashes)
    heads = F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, size))))


def simhash(shingles: Column) -> Column:
    """A bit is 1 if set in over half the hashes."""
    def with_bit(acc: Column, bit: Column) -> Column:
        ones = F.size(F.filter(shingles, lambda h: F.call_function("getbit", h, bit) == 1))
        return acc.bitwiseOR(F.when(2 * ones > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))

    # Never null, so that no filter on it is derived and run ahead of the grouping.
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), with_bit), F.lit(0).cast("long"))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks of nearly equal width."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in zip(edges, edges[1:])))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Shared over united counts of two bags of hashes."""
    every = F.array_distinct(F.concat(a, b))

    def counts(x: Column) -> tuple[Column, Column]:
        return F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))

    both = F.aggregate(every, F.struct(F.lit(0).alias("m"), F.lit(0).alias("u")), lambda acc, x: F.struct((acc["m"] + F.least(*counts(x))).alias("m"), (acc["u"] + F.greatest(*counts(x))).alias("u")))
    return F.when(F.size(every) > 0, both["m"] / both["u"]).otherwise(F.lit(0.0))


def _items(benchmark: DataFrame, radius: int, id_column: str, text_column: str) -> DataFrame:
    rows = benchmark.select(F.col(id_column).cast("long").alias("item_id"), _hashed(F.col(text_column).cast("string")).alias("h"))
    rows = rows.withColumn("n", F.size("h")).where("n > 0").withColumn("size", F.least("n", F.lit(SHINGLE)))
    by_size = F.coalesce(*(F.when(F.col("size") == s, _shingles("h", s)) for s in range(1, SHINGLE + 1)))
    rows = rows.withColumn("item_shingles", by_size).withColumn("item_print", simhash(F.col("item_shingles")))
    return rows.select("item_id", "n", "size", "item_shingles", "item_print", blocks(F.col("item_print"), radius).alias("item_blocks"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 24, most_literals: int = 50_000, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """A row per document and item that it contains: doc_id, item_id, similarity, start (word), n_words, and
    the columns of keep.

    The most similar window counts, the first of equals.  Null and empty texts
    and items without a word never match; items shorter than a shingle match
    where their words stand in a row.  Rows that share a doc_id (or have none)
    are reported together, unless the columns of keep tell them apart.
    """
    items = _items(benchmark, radius, item_column, item_text_column)
    keys = items.select("item_id", "n", "size", F.posexplode("item_shingles").alias("place", "shingle"))
    totals = keys.agg(F.count("*"), F.collect_set("size")).first()  # at most five sizes
    sizes = sorted(totals[1])
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *(keep or []), F.col(text_column).cast("string").alias("text"))
    kept = rows.columns[1:-1]
    rows = rows.select("doc_id", *kept, _hashed(F.col("text")).alias("h"))
    for size in sizes:
        rows = rows.withColumn(f"s{size}", _shingles("h", size))
    if not sizes:
        return rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), *kept).limit(0)

    if totals[0] <= most_literals:
        hits = []
        for size in sizes:
            listed = keys.where(F.col("size") == size).select("shingle").distinct().collect()  # bounded by the count above
            literals = ",".join(f"{r[0]}L" if r[0] > -(1 << 63) else "(-9223372036854775807L - 1L)" for r in listed)
            hits.append(F.expr(f"filter(transform(s{size}, (x, i) -> struct(x AS shingle, i AS at, {size} AS size)), e -> e.shingle IN ({literals}))"))
        # The outer form keeps the generator from repeating its argument in a filter below.
        found = rows.select("doc_id", *kept, *(f"s{s}" for s in sizes), F.concat(*hits).alias("hits"))
        found = found.withColumn("hit", F.explode_outer("hits")).drop("hits").where("hit is not null")
        found = found.select("doc_id", *kept, *(f"s{s}" for s in sizes), "hit.shingle", "hit.at", "hit.size").join(F.broadcast(keys), ["shingle", "size"])
    else:
        rows = rows.withColumn("row", F.xxhash64("doc_id", "h"))
        each = [rows.select("row", F.lit(s).alias("size"), F.posexplode_outer(f"s{s}").alias("at", "shingle")) for s in sizes]
        spread = each[0]
        for more in each[1:]:
            spread = spread.union(more)
        seeds = spread.where("shingle is not null").join(keys, ["shingle", "size"]).select("row", "item_id", "n", "size", "at", "place").distinct()
        found = rows.join(seeds, "row")
    start = F.greatest(F.col("at") - F.col("place"), F.lit(0))
    width = F.col("n") - F.col("size") + 1
    cut = F.coalesce(*(F.when(F.col("size") == s, F.slice(F.col(f"s{s}"), F.col("start") + 1, width)) for s in sizes))
    found = found.withColumn("start", start).select("doc_id", *kept, "item_id", "start", cut.alias("window"))
    # Seeds of one passage agree on the window.
    found = found.groupBy("doc_id", *kept, "item_id", "start", "window").agg(F.lit(1).alias("one")).drop("one")
    found = found.withColumn("print", simhash(F.col("window"))).withColumn("blocks", blocks(F.col("print"), radius))
    small = items if totals[0] > most_literals else F.broadcast(items)
    met = found.join(small, "item_id").where(F.exists(F.zip_with("blocks", "item_blocks", lambda a, b: a == b), lambda x: x))
    met = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    met = met.withColumn("similarity", weighted_jaccard(F.col("window"), F.col("item_shingles"))).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"))).alias("best")
    best = met.groupBy("doc_id", *kept, "item_id").agg(best)
    return best.select("doc_id", "item_id", "best.similarity", "best.start", F.col("best.n").alias("n_words"), *kept)
