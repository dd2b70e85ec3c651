"""Each operator against a plain version on a small table with nulls, empty and long
texts, copies, repeated and null ids, and columns whose names clash."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import ann, boost, common, components, decontam, encoder, htmltext, langid, nearcopies, packing, pii, records, simhash, substring, texts, toxicity

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghé") for _ in range(RNG.randint(1, 6))) for _ in range(300)]
PASSAGE = " ".join(RNG.choice(VOCABULARY) for _ in range(60))


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


LONG = prose(4000)
TEXTS = [
    (1, prose(80)),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (5, LONG),
    (6, LONG),
    (7, prose(20) + " " + PASSAGE + "\n" + prose(30)),
    (8, PASSAGE.replace(" ", "  ", 3)),
    (9, "a " * 90),
    (10, prose(35)),
    (11, "x"),
    (11, "x"),
    (11, prose(50)),
    (None, prose(40)),
    (None, None),
    (12, "Mail to a.b@c.de, 1.2.3.4 or 4111 1111 1111 1111; +49 (30) 123456-7. " + prose(9)),
    (13, "日本語のテキスト and emoji 🎉 <|endoftext|> a b   c"),
    (14, "ABC Def " * 30),
]
CLASHES = {"score": 1.0, "fp": "f", "h": 2, "text_key": "k", "hash": 3, "length": 4, "spans": "s", "row": 5, "label": 6, "base": 7, "n": 8}


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in CLASHES.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(3)


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoder.default_tokenizer())

    def ids(text):
        found = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        return struct.pack(f"<{len(found)}I", *found)

    return ids


# ---- op1

def test_encoder_is_the_library(tokens):
    texts = [t for _, t in TEXTS] + ["a  b", "a \n b", " x", "x ", " \n \n", "a\n \nb", "\t a", "I'm 'll it's ", "a <|endoftext|> b", "x" * 5000 + " y"]
    for most in (72 << 20, 100):
        encode = encoder.Encoder(encoder.default_tokenizer(), most).encode_many
        for _ in range(2):
            assert [x + encoder.END for x in encode(texts)] == [tokens(t) for t in texts]
    assert encode([]) == []


def test_records(spark, tokens, tmp_path):
    path = f"file://{tmp_path}/r"
    records.write_records(documents(spark), path, target_bytes=4000)
    index = records.read_index(spark, path)
    found = sorted(index.collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in found] == sorted((i is not None, i or 0) for i, _ in TEXTS)
    assert [r.start for r in found] == [0, *itertools.accumulate(r.n_tokens for r in found)][:-1]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(tokens(t)) // 4, zlib.crc32(tokens(t))) for i, t in TEXTS)
    assert index.select("file").distinct().count() > 1
    whole = Counter((r.doc_id, tuple(r.ids)) for r in records.read_records(spark, path).collect())
    assert whole == Counter((i, struct.unpack(f"<{len(tokens(t)) // 4}I", tokens(t))) for i, t in TEXTS)
    some = index.where("doc_id in (5, 12)")
    assert Counter((r.doc_id, tuple(r.ids)) for r in records.read_selected(spark, path, some).collect()) == Counter({k: v for k, v in whole.items() if k[0] in (5, 12)})


def test_records_of_one_id_fill_several_files(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([(None, "")] * 3000 + [(7, PASSAGE)] * 60, "doc_id long, text string").repartition(4)
    records.write_records(rows, path, target_bytes=2000)
    assert max(r["count"] for r in records.read_index(spark, path).groupBy("file").count().collect()) < 800


def test_files_are_ordered_by_number(spark, tmp_path):
    names = [f"part-{i:05d}-x.txt" for i in (99998, 99999, 100000, 100001)]
    rows = [(i, n, 0, 1, 0, 10 + i, 5) for i, n in enumerate(names)]
    spark.createDataFrame(rows, records.INDEX).write.parquet(f"file://{tmp_path}/index")
    assert {r.doc_id: r.start for r in records.read_index(spark, f"file://{tmp_path}").collect()} == {0: 0, 1: 10, 2: 21, 3: 33}


def test_damaged_records():
    data = records.frame(5, struct.pack("<3I", 1, 70_000, 0)) + records.frame(None, struct.pack("<I", 0))
    assert [(i, struct.unpack(f"<{len(x) // 4}I", x)) for i, x, _, _ in records.unframe(data)] == [(5, (1, 70_000, 0)), (None, (0,))]
    for at in range(len(data)):
        with pytest.raises(records.CorruptRecord):
            list(records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(records.CorruptRecord):
        list(records.unframe(data[:-3]))


# ---- op2

def test_grams_are_those_of_each_text():
    rng = random.Random(0)
    for _ in range(150):
        texts = ["".join(rng.choice("ab é\n.Z1") for _ in range(rng.randint(0, 9))) or None for _ in range(rng.randint(1, 6))]
        for n in (2, 3, 4):
            expected = Counter()
            for i, t in enumerate(texts):
                s = " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
                s = f" {s} " if s else ""
                expected.update((i, s[k : k + n]) for k in range(len(s) - n + 1))
            grams, row, which = langid.grams_of(texts, n)
            assert Counter((int(a), "".join(map(chr, grams[b]))) for a, b in zip(row, which)) == expected


def test_language(spark):
    rng = random.Random(3)
    words = {"aa": ["the", "that", "with", "from", "them"], "bb": ["der", "und", "nicht", "sich", "ein"], "cc": ["être", "pour", "une", "dans", "que"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40))), lang) for i, lang in enumerate(list(words) * 30)]
    train = spark.createDataFrame(rows[:60] + [(900, None, "aa"), (901, "the", None)], "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model.langs == ["aa", "bb", "cc"] and np.allclose(np.linalg.norm(model.prototypes, axis=1), 1, atol=1e-5)
    asked = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (502, "12 ?!"), (None, "the")], "doc_id long, text string").withColumn("score", F.lit("x"))
    found = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows)
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (500, 501, 502)) and found[None].lang_pred == "aa"
    # The cosine is that of the bundles, built n-gram by n-gram.
    text, vectors = rows[0][1], langid.Vectors(1024, 3)
    s = f" {text} "
    bundle = sum(vectors.bind(np.array([[ord(c) for c in s[k : k + 3]]]))[0].astype(float) for k in range(len(s) - 2))
    assert found[0].score == pytest.approx(float(bundle @ model.prototypes[0] / np.linalg.norm(bundle)), abs=1e-4)
    nothing = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"}
    assert langid.predict(asked.limit(0), model).count() == 0


# ---- op3

def bags(words, size=5):
    size = min(size, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()


def test_decontamination(spark):
    word = re.compile(r"[^\W_]+")
    item = PASSAGE.split()
    near = item[:30] + ["changed"] + item[31:]
    far = [w if i % 5 else "changed" for i, w in enumerate(item)]
    docs = TEXTS + [(50, prose(9) + " " + " ".join(near).upper() + "! " + prose(9)), (51, " ".join(far)), (52, "two  WORDS, here"), (53, " ".join(item[:40])), (54, PASSAGE + " " + PASSAGE)]
    items = [(1, PASSAGE), (2, None), (3, "..."), (4, "two words"), (5, prose(30)), (None, prose(12))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    expected = {}
    for i, text in docs:
        own = word.findall((text or "").lower())
        for j, t in items:
            wanted = word.findall((t or "").lower())
            for at in range(max(1, len(own) - len(wanted) + 1)):
                a, b = bags(own[at : at + len(wanted)], min(5, len(wanted))), bags(wanted)
                s = sum((a & b).values()) / max(1, sum((a | b).values()))
                if s >= 0.8 and s > expected.get((i, j), (0,))[0]:
                    expected[i, j] = s, at
    for most in (50_000, 0):
        found = decontam.find_contaminated(documents(spark, docs), benchmark, most_literals=most)
        assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in found.collect()} == expected
    assert {7, 8, 50, 52, 54} <= {i for i, _ in expected} and not {51, 53} & {i for i, _ in expected}
    assert decontam.find_contaminated(documents(spark), benchmark.where("item_id = 2")).count() == 0
    assert decontam.find_contaminated(documents(spark).limit(0), benchmark).count() == 0


def test_blocks_miss_nothing(spark):
    rng = random.Random(5)
    pairs = [(a, a ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 24)))) for a in (rng.getrandbits(63) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long")
    met = df.where(F.exists(F.zip_with(decontam.blocks(F.col("a"), 24), decontam.blocks(F.col("b"), 24), lambda x, y: x == y), lambda x: x))
    assert met.count() == 200


# ---- op4

def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(spark):
    docs = [r for r in TEXTS if r[0] is not None] + [(60 + i, LONG + f" w{i}") for i in range(5)] + [(70, "A-Z ÀÉ a-z b"), (71, "a-z Àé A-z b"), (72, "a-z ÀÉ a-z b")]
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = roots_of(prints, 3)
    least = {r: min(docs[i][0] for i, x in enumerate(roots) if x == r) for r in roots}
    expected = Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(docs, prints, roots))
    assert rows_of(simhash.near_duplicates(documents(spark, docs)), "doc_id", "fingerprint", "component_id") == expected
    assert rows_of(simhash.near_duplicates(documents(spark, docs), node_rows=2), "doc_id", "fingerprint", "component_id") == expected
    alone = simhash.near_duplicates(documents(spark, [(None, "a b c d")])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [3, 8])
def test_near_links_connect_like_all_links(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 2), replace=False)) for b in base for _ in range(12)}
    prints |= {int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}  # more than are compared at once
    prints = sorted(prints)
    roots = roots_of(prints, radius)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    for rows in (2048, 50):
        links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, rows)
        found = {r.node: r.root for r in components.connected_components(links).collect()}
        groups = {}
        for s, r in zip(signed, roots):
            groups.setdefault(r, []).append(s)
        assert all({found.get(s, s) for s in g} == {min(g)} for g in groups.values())


def test_gray_index():
    rng = np.random.default_rng(1)
    codes = np.arange(64, dtype=np.uint64)
    assert (simhash.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()
    prints = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    prints = prints[np.argsort(simhash.gray_rank(prints))]
    near = prints[:40] ^ np.uint64(5 << 30)
    index = simhash.GrayIndex(prints)
    for asked in (prints[:60], near):
        found = Counter(zip(*(x.tolist() for x in index.within(asked, 3))))
        assert found == Counter((i, int(j)) for i, x in enumerate(asked) for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= 3))
    # Whole groups are left by what differs so far: most fingerprints are never looked at.
    assert index.pruned > 0.7 * 100 * len(prints) and index.checked < 0.6 * 100 * len(prints)
    for x in prints[:20]:
        assert set(simhash.GrayIndex(prints).within(np.array([x]), 3, np.array([7]))[1]) == {j for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= 3) if j > 7}


def test_ranges_of_the_gray_order():
    for n, radius in ((0, 3), (1, 3), (10**5, 3), (10**12, 3), (10**6, 8)):
        orders = simhash.gray_ranges(n, radius, 1024)
        assert len(orders) == radius + 1 and all(bits <= 64 // (radius + 1) + 1 for _, bits in orders)
    assert {bits for _, bits in simhash.gray_ranges(10**5, 3, 1024)} == {7}


def jaccard(a, b):
    a, b = (t.encode().lower().split() for t in (a, b))  # A-Z only
    a, b = (set(zip(*(t[i:] for i in range(min(5, len(t)))))) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def staying(spark, docs, **how):
    """The ids that stay, once all that the operator promises is checked on all pairs."""
    every, stays = nearcopies.similar_copies(documents(spark, docs), keep=[F.lit(5).alias("first_id_"), "n"], **how)
    text = {hashlib.md5((t or "").encode()).digest(): t or "" for _, t in docs}
    ids = {}
    for i, t in docs:
        ids.setdefault(hashlib.md5((t or "").encode()).digest(), []).append(i)
    rows = {bytes(r.text_key): r for r in every.collect()}
    assert set(rows) == set(text)
    for key, r in rows.items():
        known = [i for i in ids[key] if i is not None]
        assert r.first_id == (min(known) if known else None)
        if r.leader_key is not None:
            assert rows[bytes(r.leader_key)].leader_key is None and jaccard(text[key], text[bytes(r.leader_key)]) >= 0.8
    left = [k for k, r in rows.items() if r.leader_key is None]
    assert not [(text[a][:200], text[b][:200]) for a, b in itertools.combinations(left, 2) if jaccard(text[a], text[b]) >= 0.8]
    kept = stays.collect()
    assert Counter((r.first_id, r.text or "", r.first_id_, r.n) for r in kept) == Counter((rows[k].first_id, text[k], 5, 8) for k in left)
    return {r.first_id for r in kept}


def test_similar_copies(spark):
    words = prose(300).split()
    copies = [(100, " ".join(words))] + [(101 + i, " ".join(words[: 40 * i] + ["changed"] + words[40 * i + 1 :])) for i in range(6)]
    docs = TEXTS + copies + [(99, " ".join(w if i % 4 else "other" for i, w in enumerate(words))), (98, "  ".join(words).replace("a", "A"))]
    stays = staying(spark, docs)
    assert {98, 99, 1, 5, 10} <= stays and not set(range(100, 107)) & stays
    assert len(stays & {2, 3, 4}) == 1  # texts without words
    assert nearcopies.similar_copies(documents(spark).limit(0))[0].count() == 0


def test_similar_copies_behind_a_less_similar_leader(spark):
    # One fingerprint group, led in every bucket by texts that neither copy is measured equal to.
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def but(*places):
        return " ".join(f"x{i}" if i in places else w for i, w in enumerate(base))

    docs = [(i, but(*range(3 + i, 200, 10))) for i in range(8)] + [(50, but(50)), (51, but(150))]
    assert all(jaccard(a, b) < 0.8 for a, b in itertools.combinations([t for _, t in docs[:9]], 2))
    assert jaccard(docs[8][1], docs[9][1]) > 0.8
    assert staying(spark, docs, radius=24) == {*range(8), 50}


def test_chains_of_copies_keep_one_that_each_is_like(spark):
    # Each text is like its neighbours and unlike those further off, so leaders go and their followers are open again.
    rng = random.Random(25)
    docs, base = [], 0
    for family in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for turn in range(rng.randint(2, 9)):
            docs.append((base + rng.randrange(10**6), " ".join(words)))
            at = rng.randrange(0, 250)
            words = words[:at] + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([3, 15, 22]))] + words[at + rng.choice([3, 15]) :]
    assert len(staying(spark, docs)) > 25
    assert staying(spark, docs, rounds=0, node_rows=2) == staying(spark, docs, rounds=0)


def test_cut_and_lengthened_copies(spark):
    rng = random.Random(22)
    docs, expected = [], set()
    for i in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 200, 600]))]
        keep = rng.choice([0.81, 0.85, 0.9, 0.78])
        whole, cut = " ".join(words), " ".join(words[: int((len(words) - 4) * keep) + 5])
        docs += [(2 * i, whole), (2 * i + 1, cut)] if i % 2 else [(2 * i, cut), (2 * i + 1, whole)]
        expected |= {2 * i} | ({2 * i + 1} if jaccard(whole, cut) < 0.8 else set())
    assert 140 < len(expected) < 165
    assert staying(spark, docs) == expected


@pytest.mark.parametrize("node_rows", [4, 2048])
def test_candidates_lose_no_pair(spark, node_rows):
    rng = random.Random(23)
    pools = [[f"{p}{i}" for i in range(12)] for p in "abc"]
    docs = {" ".join(rng.choice(pools)[: rng.randint(1, 12)] + rng.choice(pools)[: rng.randint(0, 12)]) for _ in range(150)}
    docs = [(i, t) for i, t in enumerate(sorted(docs))]
    pack = texts.zstandard.ZstdCompressor().compress
    rows = spark.createDataFrame([(i, int(i % 3 == 0), pack(t.encode())) for i, t in docs], "id long, settled int, packed binary").repartition(3)
    often = nearcopies.common_shingles(rows, len(docs), 5, 40)
    sets = [nearcopies.shingle_set(t.encode(), 5) for _, t in docs]
    pairs = list(itertools.combinations(range(len(docs)), 2))
    shared = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in pairs}
    for most in (0, 10**6):
        made = {(r.a, r.b) for r in nearcopies.candidates(rows, often, 0.8, 5, True, node_rows, most).collect()}
        alike = {(i, j) for i, j in pairs if (i % 3 or j % 3) and shared[i, j] >= 0.8 * (len(sets[i]) + len(sets[j]) - shared[i, j])}
        assert len(alike) > 20 and alike <= made and len(made) < len(pairs) / 4 and all(i % 3 or j % 3 for i, j in made)


def test_common_shingles_are_counted_by_text(spark):
    rng = random.Random(24)
    found = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) for _ in range(60)] + [None, "", "one word", "a b a b a b a b"]
    pack = texts.zstandard.ZstdCompressor().compress
    rows = spark.createDataFrame([(i, 0, None if t is None else pack(t.encode())) for i, t in enumerate(found)], "id long, settled int, packed binary").repartition(4)
    counts = Counter(int(x) >> nearcopies.KEY_SHIFT for t in found for x in nearcopies.shingle_set((t or "").encode(), 5))
    counts = {k: n for k, n in counts.items() if n > 2}
    assert len(counts) > 20 and nearcopies.common_shingles(rows, len(found), 5) == counts
    few, above = nearcopies.common_shingles(rows, len(found), 5, most_common=10), sorted(counts.values())[-11]
    assert few == {k: n for k, n in counts.items() if n > above} and few
    assert nearcopies.common_shingles(rows.limit(0), 0, 5) == {}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (5, 5)]
    for few in (500_000, 0):
        found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_what_goes_is_linked_to_what_stays(spark):
    rng = random.Random(31)
    links = {(j, i) for i, j in (sorted(rng.sample(range(80), 2)) for _ in range(120))} | {(100 + i, 100 + i - 1) for i in range(1, 12)}
    stays, gone = set(), {}
    for x in sorted({x for p in links for x in p}):
        before = [b for a, b in links if a == x and b in stays]
        if before:
            gone[x] = min(before)
        else:
            stays.add(x)
    rows = spark.createDataFrame([(a.to_bytes(4), b.to_bytes(4)) for a, b in links], "later binary, earlier binary")
    for few in (200_000, 30, 0):
        found = {int.from_bytes(r.text_key): int.from_bytes(r.leader_key) for r in nearcopies.resolve(rows, few).collect()}
        assert set(found) == set(gone) and all((x, y) in links and y in stays for x, y in found.items())
    assert nearcopies.resolve(rows.limit(0)).count() == 0


# ---- op5

def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(5, 60))]
        if toxic:
            words += [rng.choice(["nasty", "vile", "grubbylo", "grubbyna"]) for _ in range(4)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels[:300] + [(None, 1), (9999, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    docs = documents(spark, rows + [(1000, None), (1001, ""), (1002, "vile"), (None, "nasty vile")])
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(300, 400)]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert sum(found[i].predicted == (i % 4 == 0) for i in held) >= 97
    assert found[1000].score == found[1001].score == model.base and found[1000].neighbours == []
    assert found[300].predicted and set(found[300].neighbours) <= set(range(300))
    assert toxicity.fit(docs, labels).slope == model.slope
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = [toxicity.unit({int(t): int(n) for t, n in zip(rng.integers(0, 40, 6), rng.integers(1, 5, 6))}, np.ones(40) + np.arange(40) % 3) for _ in range(500)] + [{}]
    for block in (1, 16, 1000):
        index = toxicity.Index(vectors, block)
        for at in range(0, 500, 25):
            scores = [(-sum(vectors[at].get(t, 0) * w for t, w in v.items()), i) for i, v in enumerate(vectors) if i != at]
            expected = [-s for s, _ in sorted(scores)[:7] if s < 0]
            assert np.allclose(index.nearest(vectors[at], 7, but=at)[1], expected)


# ---- op6

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if good[kind]():
                out.append((m.start(), number, m.end()))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(9)
    odd = ["a@b.c%d@e.f x..y@z.w- 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "+12345678901234567890 4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111", "é🎉4111111111111111é +49 30 1234567", "1 " * 3000, "a" * 5000 + "@", "@" * 300, "x@y." * 50]
    odd += ["".join(rng.choice("01.+- @a()é4") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    odd += [f'say token = "{rng.getrandbits(160):040x}" now' for _ in range(20)] + [f"number {rng.randint(10**15, 10**16 - 1)} is" for _ in range(20)]
    docs = TEXTS + [(1000 + i, t) for i, t in enumerate(odd)]
    table = documents(spark, docs)
    found = pii.find_spans(table, *pii.fit(table))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    digest = pii.digest(found)
    expected = Counter()
    for i, t in docs:
        spans = plain_spans(t)
        counts = tuple(sum(k == n for _, k, _ in spans) for n in range(4))
        expected[(i, *counts, hashlib.sha256(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())] += 1
    assert rows_of(digest, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == expected
    keys = [r for r in digest.collect() if r.doc_id is not None and "key:13:53" in r.spans]
    assert len(keys) == 20
    shown = {r.doc_id: r.x for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("base")).alias("x")).collect()}
    assert shown[12].startswith("Mail to <email>, <ip> or <card>; <phone>. ") and shown[5] == LONG and shown[3] == ""
    empty = table.limit(0)
    assert pii.digest(pii.find_spans(empty, *pii.fit(empty))).count() == 0


def test_every_candidate_counts(spark, monkeypatch):
    """Trees and threshold come from all documents, also where features have to be rounded."""
    seen = []

    def spy(x, y, names, weight=None, fold=None):
        weight = np.ones(len(x)) if weight is None else weight
        seen.append((weight.sum(), (weight * y).sum(), len(x)))
        return fitted(x, y, names, **{} if fold is None else {"weight": weight, "fold": fold})

    fitted = boost.fit
    monkeypatch.setattr(pii.boost, "fit", spy)
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(rng.randint(8, 20)))
    rows = [(i, f"{'token =' if i % 5 == 0 else 'see'} {key()} x") for i in range(5000)]
    table = documents(spark, rows)
    whole, threshold = pii.fit(table)
    assert seen[0][:2] == (5000, 1000) and seen[0][2] > 3 * 40
    coarse, other = pii.fit(table, most_cells=40)
    assert seen[1][:2] == (5000, 1000) and seen[1][2] <= 3 * 40
    for model, at in ((whole, threshold), (coarse, other)):
        found = pii.digest(pii.find_spans(table, model, at)).where("spans like 'key:%'").select("doc_id").collect()
        assert {r.doc_id for r in found} == set(range(0, 5000, 5))


def test_weights_stand_for_rows():
    rng = np.random.default_rng(5)
    x, weight = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(1, 5, 200)
    y, fold = (x[:, 0] + x[:, 1] > 5).astype(float), rng.integers(0, 4, 200)
    once = boost.fit(x, y, ["a", "b", "c"], weight=weight.astype(float), fold=fold)
    many = boost.fit(*(np.repeat(v, weight, axis=0) for v in (x, y)), ["a", "b", "c"], fold=np.repeat(fold, weight))
    assert np.allclose(once.probability(x), many.probability(x))
    p = many.probability(x)
    assert boost.threshold(p, y, 0.9, weight.astype(float)) == boost.threshold(np.repeat(p, weight), np.repeat(y, weight), 0.9)


def test_boosted_trees_in_sql(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    model = boost.fit(x, y, ["a", "b", "c"])
    p = model.probability(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    assert np.allclose([r.p for r in df.selectExpr(model.sql() + " AS p").collect()], p[:50])
    assert boost.threshold(np.array([0.9, 0.8, 0.8, 0.1]), np.array([1, 1, 0, 0]), 0.9) == 0.9


# ---- op7

def test_nearest(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.standard_normal(12).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[3][1]) for i in range(400)]  # one very common vector
    bad = [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [float("inf")] + [0.0] * 11), (5400, [1.0, None] + [0.0] * 10), (5500, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    found = {}
    for r in ann.nearest(df, k=10, every=100, list_rows=100, tile_rows=64, tile_queries=4).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, data = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    assert set(found) == {i for i, _ in vectors if i % 100 == 0}
    hits = 0
    for q, rows in found.items():
        gaps = np.sqrt(((data - data[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        exact = [i for i in np.lexsort((ids, gaps)).tolist() if ids[i] != q][:10]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert all(s == pytest.approx(gaps[np.flatnonzero(ids == v)[0]], abs=1e-9) for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {int(ids[i]) for i in exact})
    assert hits >= 0.9 * 10 * len(found)
    assert [v for _, v, _ in sorted(found[2100])] == [3, *range(2000, 2009)]
    few = ann.nearest(df.where("vec_id < 4"), k=10, every=1)
    assert few.count() == 12
    assert ann.nearest(df.where("vec_id = 5000")).count() == 0 and ann.nearest(df.limit(0)).count() == 0


def test_scan_abandons_most_candidates():
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 64)) * 1.5
    data = centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 64))
    asked = np.arange(0, 6000, 100)
    exact = [np.lexsort((np.arange(6000), np.where(np.arange(6000) == q, np.inf, ((data - data[q]) ** 2).sum(1))))[:10] for q in asked]
    best = {int(q): np.sqrt(((data[e[-1]] - data[q]) ** 2).sum()) for q, e in zip(asked, exact)}
    for limits in (np.full(len(asked), np.inf), np.array(list(best.values()))):
        seen = {}
        found = ann.search_tile(data[asked], asked, limits, data, [[i] for i in range(6000)], 10, ann.rotation(64), 16, 2.1, seen=seen)
        hits = sum((q, int(i)) in {(a, b) for a, b, _ in found} for q, e in zip(asked.tolist(), exact) for i in e)
        assert hits >= 0.97 * 600 and seen["whole"] < 0.2 * seen["all"]


# ---- op8

def test_packing(spark, tokens):
    for capacity in (64, 2048):
        found = packing.pack_documents(documents(spark), capacity, with_ids=True, group_rows=3).collect()
        pieces = {}
        for r in found:
            assert len(r.ids) == 4 * r.length <= 4 * capacity and zlib.crc32(r.ids) == r.ids_crc32
            pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for lie in pieces.values():
            lie.sort()
            assert lie[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(lie, lie[1:])) and sum(lie[-1]) <= capacity
        expected = Counter()
        for i, t in TEXTS:
            ids = tokens(t)
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            expected.update((i, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    assert packing.pack_documents(documents(spark).limit(0)).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[at] <= capacity}.values():
            bins[j] += items[at]
            go(at + 1, bins)
            bins[j] -= items[at]
        go(at + 1, [*bins, items[at]])

    go(0, [])
    return best[0]


def test_plans_are_as_short_as_can_be():
    rng = random.Random(6)
    for _ in range(250):
        capacity = rng.choice([10, 20, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 9)))
        made = packing.plan(dict(counts), capacity)
        held = Counter()
        for pattern, times in made:
            assert sum(n * k for n, k in pattern) <= capacity
            held.update({n: k * times for n, k in pattern})
        assert held == counts
        assert packing.lower_bound(dict(counts), capacity) <= sum(k for _, k in made) == fewest(list(counts.elements()), capacity)
    assert packing.dominates((7, 3), (4, 3, 3)) and not packing.dominates((4, 3), (7,))


def test_the_search_beats_best_fit():
    # Two pairs that fill exactly, which best fit decreasing misses.
    counts = {6: 2, 4: 2, 5: 2, 3: 2, 2: 1}
    assert sum(k for _, k in packing.plan(counts, 10)) == fewest(list(Counter(counts).elements()), 10)


@pytest.mark.parametrize("counts, sequences", [({410: 1000, 409: 1000}, 400), ({293: 700, 292: 4200}, 700)])
def test_the_search_fills_sequences_with_many_pieces(counts, sequences):
    made, held = packing.plan(counts, 2048), Counter()
    for pattern, times in made:
        assert sum(n * k for n, k in pattern) <= 2048
        held.update({n: k * times for n, k in pattern})
    assert held == counts and sum(k for _, k in made) == sequences


def test_fillings_are_all():
    rng = random.Random(24)
    for _ in range(100):
        counts = np.zeros(13, np.int64)
        for _ in range(rng.randint(0, 7)):
            counts[rng.randint(1, 12)] += 1
        waste, expected = rng.randint(0, 12), set()
        for many in itertools.product(*(range(int(n) + 1) for n in counts)):
            gap = 12 - sum(x * k for x, k in enumerate(many))
            if 0 <= gap <= waste and all(k == counts[x] for x, k in enumerate(many) if x <= gap):
                expected.add(tuple((x, k) for x, k in reversed(list(enumerate(many))) if k))
        found = list(packing.fillings(counts, 12, waste))
        assert len(found) == len(set(found)) and set(found) == expected


# ---- op9

PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy, now. Please.</div><article><h1>Title &amp; more</h1><p>One,\n two.<br>three<p><b>Fo</b>ur &lt; five.</article><footer>&copy; x</footer>", "Title & more One, two. three Four < five."),
    ("<body><div id=menu><a href=/>Home</a> <a href=/b>More</a></div><div class='content'><h2>Title</h2><p>One, two. Three &amp; four.</p><p>Five.</p></div><div class=sidebar><p>Other things, here.</p></div><p class=cookie-notice>We use cookies.</p>", "Title One, two. Three & four. Five."),
    ("<main><article><p>a, b.<aside>x</aside><section class=comments><p>hi, there. you.</p></section><form><label>Name</label></form><script>if (a<b) {}</script></article></main>", "a, b."),
    ("<p>a</p><!-- x <p>no</p> --><p>b, c.", "a b, c."),
    ("just text", "just text"),
    ("", ""),
    (None, ""),
    ("<p", ""),
    ("<article><p>cut off &amp; <a href='", "cut off &"),
    ("<nav>only</nav>", ""),
    ("<article>" + "<p>word, word.</p>" * 3000 + "</article>", " ".join(["word, word."] * 3000)),
    ("<div>" * 3000 + "deep, text." + "</div>" * 3000, "deep, text."),
    ("<article><p title='a>b' data=\"<\">x &zzz; &#x41;&#66;</p></article>", "x &zzz; AB"),
]


def test_main_text(spark):
    for source, expected in PAGES:
        assert htmltext.extract(source) == expected
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(0, None, None), (None, None, "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    expected = Counter((i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)) + Counter([(0, None, "", 0), (None, None, "x", 1)])
    assert rows_of(htmltext.extract_pages(df), "page_id", "url", "text", "n_chars") == expected
    assert htmltext.extract_pages(df.limit(0)).count() == 0


def test_marks_are_evidence_only():
    long = "It rained on Monday, and the river rose. By noon, the lower meadows stood under water. " * 3
    for source, expected in (
        (f"<div class='content no-sidebar'><p>{long}</p></div><div>hi</div>", long),
        (f"<article class='post comments-open'><p>{long}</p></article><div class=comments><p>Nice, really. I like it.</p></div>", long),
        (f"<div id='share-price-report'><p>{long}</p></div>", long),
        (f"<div class=a data-x='{'>' * 5000}'><p>{long}</p></div><div class=b><a href=x>Home</a></div>", long),
        (f"<nav><ul><li><a href=x>{long}</a></li></ul></nav><p>Short, but so it is.</p>", "Short, but so it is."),
        (f"<article><p>{long}</p></article><aside><p>Look here, it is new.</p></aside><footer><p>All rights, as ever.</p></footer>", long),
    ):
        assert htmltext.extract(source) == expected.strip()


def plain_path_scores(blocks):
    """path_scores by loops."""
    paths = list(dict.fromkeys(b.path for b in blocks))
    gauss = [math.exp(-0.5 * d * d) for d in range(-2, 3)]
    gauss = [g / sum(gauss) for g in gauss]
    fused = dict.fromkeys(paths, 1.0)
    length = [max(0, len(b.text) - 2 * b.linked) for b in blocks]
    marks = [sum(c in ".,;:!?…。，、؟" for c in b.text) if len(b.text) > 2 * b.linked else 0 for b in blocks]
    for values in (length, marks):
        total = {p: sum(v for v, b in zip(values, blocks) if b.path == p) for p in paths}
        nodes = Counter(b.path for b in blocks)
        each = [total[b.path] / nodes[b.path] for b in blocks]
        along = [sum(g * each[i + d] for g, d in zip(gauss, range(-2, 3)) if 0 <= i + d < len(each)) for i in range(len(each))]
        ratio = {p: sum(a for a, b in zip(along, blocks) if b.path == p) / nodes[p] for p in paths}
        for p in paths:
            fused[p] *= (ratio[p] / max(sum(ratio.values()) / len(paths), 1e-9) + 0.05) * (total[p] / max(sum(total.values()) / len(paths), 1e-9) + 0.05)
    return {p: fused[p] if sum(v for v, b in zip(length, blocks) if b.path == p) else 0.0 for p in paths}


def unmarked(page):
    """The page without anything that HTML marks: all that tells its parts apart is their text."""
    page = page.replace('<div class="ad">', "<div class=d>")
    page = re.sub(r"<(nav|footer|article)\b[^>]*>", lambda m: f"<div class={m[1][0]}x>", page)
    return re.sub(r"</(nav|footer|article)>", "</div>", page)


def test_tag_path_ratios_choose(monkeypatch):
    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for page in pages[:60]:
        blocks = htmltext.blocks_of(page)
        found, expected = htmltext.path_scores(blocks), plain_path_scores(blocks)
        assert found.keys() == expected.keys() and all(abs(found[p] - expected[p]) <= 1e-6 * (1 + expected[p]) for p in found)
    whole = [htmltext.extract(p) for p in pages]
    chosen = [htmltext.extract(unmarked(p)) == t for p, t in zip(pages, whole)]
    assert sum(chosen) > 0.85 * len(pages)
    monkeypatch.setattr(htmltext, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
    assert sum(htmltext.extract(unmarked(p)) == t for p, t in zip(pages, whole)) < 0.05 * len(pages)


def test_main_text_of_several_parents():
    one, two = "<p>One, two. Three, four.</p>" * 3, "<p>Five, six. Seven, eight.</p>" * 2
    text = ["One, two. Three, four."] * 3 + ["Five, six. Seven, eight."] * 2
    page = f"<body><div class=content><h2>Title</h2><div class=intro>{one}</div><div class=more>{two}</div></div><div><a href=/>Home</a></div>"
    assert htmltext.extract(page) == " ".join(["Title", *text])
    assert htmltext.extract(f"<body><article class=a>{one}</article><article class=b>{two}</article>") == " ".join(text)
    # The ratios decide inside a marked article as well.
    assert htmltext.extract(f"<article>{one}<div class=list><a href=/>Other things</a></div></article>") == " ".join(text[:3])


@pytest.mark.parametrize("size", [5_000, 1_000_000])
def test_long_attribute_values(size):
    value = "<p class=ad>no, no.</p> > " * (size // 26 + 1)
    for quote in "\"'":
        long = f"data-props={quote}{value}{quote}"
        page = f"<article><div {long}><p>a, b.</p></div><script {long}>x > y, z.</script><div {long} class=sidebar><p>s, t.</p></div><nav {long}>n</nav><p {long}>c, d.</p></article><p>"
        assert htmltext.extract(page) == "a, b. c, d."
    # A quote that nothing closes ends with its tag; many of them take no more than linear time.
    assert htmltext.extract("<article><p title=\"x>a, b.</p><p>c, d.</p></article>") == "a, b. c, d."
    assert htmltext.extract("<article>" + "<p title='>a, b.</p>" + "<p " * (size // 3) + ">c, d.</article>") == "a, b. c, d."


# ---- op10

def plain_removal(docs, width):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = Counter()
    for (i, _), w in zip(docs, words):
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_substring_dedup(spark, batches):
    docs = TEXTS + [(80 + i, prose(20) + " " + PASSAGE[5 * i :] + " " + prose(3)) for i in range(4)] + [(90, "b c " * 40), (91, PASSAGE)]
    for width, grain in ((35, 8), (9, 3)):
        found = substring.remove_repeats(documents(spark, docs), width, grain, batches, with_text=True)
        assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(docs, width)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found.collect())
        for most in (1, 50) if batches == 1 and width == 9 else ():
            found = substring.remove_repeats(documents(spark, docs), width, grain, batches, hot_rows=2, most_hot=most)
            assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(docs, width)
    assert substring.remove_repeats(documents(spark).limit(0)).count() == 0


def rows_of_joins(spark, since, kind):
    """Rows that came out of joins of that kind, on first and second, in queries after the first `since`."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for i in range(since, store.executionsCount()):
        run = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and f"{kind}" in node.desc() and "first" in node.desc():
                counts = (m for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows")
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in counts if values.contains(m.accumulatorId()))
    return total


def test_common_windows_are_settled_by_text(spark):
    line = "over and over the same eleven words stand in this line"
    docs = [(i, prose(9) + " " + f"{line} " * 20 + prose(40)) for i in range(30)] + [(90, PASSAGE), (91, PASSAGE + " x")]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = substring.remove_repeats(documents(spark, docs), hot_rows=25)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(docs, 35)
    assert rows_of_joins(spark, since, "LeftSemi") <= len(docs)  # and not one for each of some 5,000 places


def test_runs_are_compacted(spark):
    index = substring.FingerprintIndex(spark, fanout=2)
    batches = [[(1, 50), (2, 50)], [(2, 51), (3, 51)], [(3, 52), (3, 53), (9, 53)], [(9, 54), (7, 54), (7, 55)]]
    met = []
    for rows in batches:
        found = index.add_batch(spark.createDataFrame(rows, substring.RUN))
        met.append({(r.hash, r.id) for r in found.collect()})
        index.compact()
        assert len(index.runs) <= 2
    assert met == [set(), {(2, 50), (2, 51)}, {(3, 51), (3, 52), (3, 53)}, {(9, 53), (9, 54), (7, 54), (7, 55)}]


def test_batches_are_judged_against_history(spark, tmp_path):
    docs = TEXTS + [(80 + i, prose(20) + " " + PASSAGE[5 * i :] + " " + prose(3)) for i in range(6)] + [(91, PASSAGE), (92, prose(50))]
    cuts, path = (0, 9, 18, len(docs)), f"file://{tmp_path}/history"
    for start, stop in zip(cuts, cuts[1:]):
        found = substring.remove_repeats(documents(spark, docs[start:stop]), history=path)
        late = plain_removal([(i if at >= start else "earlier", t) for at, (i, t) in enumerate(docs[:stop])], 35)
        assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter({k: n for k, n in late.items() if k[0] != "earlier"})
    index = substring.FingerprintIndex(spark, f"{path}/index")
    assert index.number >= 9 and 1 <= len(index.runs) <= 2
    other = substring.FingerprintIndex(spark, f"{path}/index")
    index._commit(index.runs)
    with pytest.raises(RuntimeError):
        other._commit(other.runs)


def test_window_hashes_are_of_the_words():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 5, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = substring.window_hashes(words, 7, substring._BASES[0])
    same = {}
    for k, h in enumerate(hashes.tolist()):
        assert same.setdefault(tuple(words[k : k + 7].tolist()), h) == h
    assert len(set(same.values())) == len(same)


def test_shared_folder_is_the_sessions(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == named if named else common.shared_dir(spark).startswith("file:/")
