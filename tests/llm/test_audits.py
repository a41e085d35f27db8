"""Exact dedup, the audit of filters and the audit of sources against SQL and brute force."""

import hashlib
import os
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from karyospark.llm import divergence, exact_dedup, interactions, registry
from karyospark.llm.common import checkpoint

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"
LONG = "Alpha beta gamma delta " * 20_000
ROWS = [
    (None, None, None, None), (None, None, None, None), (None, "", "", ""), (1, "", "en", None), (1, "", "en", "s1"), (2, "one & ONE", "en", "s1"),
    (3, "one & ONE", "en", "s1"), (3, "one & ONE", "en", "s1"), (4, LONG, "en", "s2"), (5, LONG, "fr", "s2"), (6, LONG[:-1] + "x", "fr", "s2"),
    (7, "x" * 50_000, "fr", "s3"), (8, "É é word, word; \U0001f600\x00\x1c", "fr", "s3"), (9, "é" * 32, "fr", None), (10, "é" * 32, "en", "s3"),
]
CLASH = ("row", "full", "n", "best", "__key", "__asked", "part", "mask", "words", "own", "term", "value", "item", "rank", "p", "q", "b", "i", "m", "v", "keep_id", "text_sha256", "quality", "__deal", "first_id", "prefix", "len")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


def equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got = registry.queries()[name](spark, SF)
    names = got.columns
    rows = con.execute(f"select {', '.join(names)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_filter_audit", "op13_source_divergence"])
def test_equals_sql(spark, name):
    equal_to_sql(spark, name)


@pytest.mark.parametrize("part", [1000, 3])
def test_exact_dedup_of_odd_rows(spark, docs, monkeypatch, part):
    monkeypatch.setattr(exact_dedup, "LARGE_PART", part)
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.deduplicated(docs, digest=True).collect()
    want = [(i, largest[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS]
    assert sorted(map(repr, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(map(repr, want))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.deduplicated(docs.limit(0), digest=True).count() == 0


def test_prefixes_and_lengths_that_collide(spark, monkeypatch):
    """Texts of one length and prefix, and a bitmap so small that all keys meet, leave the groups as they are."""
    draw = random.Random(3)
    texts = ["same beginning of all of these " * 3 + "".join(draw.choice("ab") for _ in range(4)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes = Counter(texts)
    for bits in (8, 1 << 23):
        monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
        got = exact_dedup.deduplicated(docs).collect()
        assert {r["doc_id"]: r["group_size"] for r in got} == {i: sizes[t] for i, t in enumerate(texts)}
        assert sum(r["kept"] for r in got) == len(sizes)


def test_only_survivors_are_hashed_in_full(spark):
    docs = spark.createDataFrame([(1, "a" * 100), (2, "a" * 100), (3, "b" * 101), (4, "c" * 100), (5, "a" * 99 + "b")], "doc_id bigint, text string")
    full = {r["doc_id"]: r["full"] is not None for r in exact_dedup.refined(docs).collect()}
    assert full == {1: True, 2: True, 3: False, 4: False, 5: True}


def plain_mask(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rules = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
    return sum(1 << i for i, r in enumerate(rules) if r)


def test_filter_audit_of_odd_rows(spark, docs):
    labels = [(1, 1, 0), (3, None, None), (4, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (99, 1, 1)]
    told = {}
    for i, good, toxic in labels:
        old = told.get(i, (False, False))
        told[i] = (old[0] or good == 1, old[1] or toxic == 1)
    del told[None]
    parts = {}
    for i, t, _, s in ROWS:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, *_ in ROWS)
        parts.setdefault(s or "", []).append((plain_mask(t or "", copy), *told.get(i, (False, False))))
    want = {}
    for part, rows in parts.items():
        shares = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                shares[f] += len(gone)
                fails = sum(1 for r in rows if r[0] & bit)
                want[part, order, step] = [len(left), len(gone), fails - len(gone), sum(r[0] == bit for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                want[part, order, step].append(shares[f])
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = interactions.audited(interactions.mask_counts(interactions.failures(docs), labelled)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want and len(got) == len(want)
    assert interactions.audited(interactions.mask_counts(interactions.failures(docs.limit(0)), labelled)).count() == 0


def test_shares_sum_to_all_that_is_removed():
    draw = random.Random(1)
    counts = {m: draw.randrange(1 << 40) for m in range(32)}
    f = interactions.Removal(counts)
    assert f.corner(31) == sum(counts.values()) - counts[0] == sum(f.share(b) for b in interactions.BIT.values())
    assert all(f.corner(s) == sum(n for m, n in counts.items() if m & s) for s in range(32))


def plain_divergence(rows, least, k):
    terms = [(l or "", s or "", [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, l, s in rows]
    out = []
    for lang in {l for l, *_ in terms}:
        mine = [(s, w) for l, s, w in terms if l == lang]
        seen = Counter(t for _, w in mine for t in set(w))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter(t for z, w in mine if z == s for t in w if t in kept) for s, _ in mine}
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            far = sorted((-sum(abs(p[s][t] - p[z][t]) for t in kept), z.encode(), z) for z in counts if z != s)
            out += [(lang, s, "pair", z, -v, i) for i, (v, _, z) in enumerate(far, 1)]
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(best[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("least,k,few,block", [(1, 3, 1, 2), (2, 50, 256, 256), (1, 5, 4, 3), (99, 5, 4, 256)])
def test_divergence_equals_brute_force(spark, docs, monkeypatch, least, k, few, block):
    """Ties of many terms, several blocks of sources, groups without terms, and nothing kept at all."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    draw = random.Random(least + k)
    words = ["".join(draw.choice("abé") for _ in range(draw.randrange(1, 9))) for _ in range(60)] + ["zz", "zza", "zzab", "ZZAB", "y" * 3000]
    rows = [r for r in ROWS if r[0] != 4] + [(i, " ".join(draw.choices(words, k=draw.randrange(0, 40))), draw.choice(("en", "fr")), f"s{draw.randrange(7)}") for i in range(20, 80)]
    rows += [(90, " ".join(words), "en", "s1"), (91, "...", "de", "s1"), (92, None, "de", "s2"), (93, "1 2 3", "en", "only numbers")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})
    got = divergence.diverging(frame, least, k, few).collect()
    assert sorted(map(repr, map(tuple, got))) == plain_divergence(rows, least, k)


def test_divergence_of_nothing(spark, docs):
    assert divergence.diverging(docs.limit(0)).count() == 0


def test_top_of_long_ties(spark):
    """All values are equal and items share long beginnings: the first by their bytes come out, groups of few rows whole."""
    draw = random.Random(2)
    rows = [("g", "é" * 3 + "a" * draw.randrange(40) + draw.choice("abcé") + str(i), 7) for i in range(500)] + [("h", "x", 1), ("h", "y", (1 << 33) - 1)] + [("e", "q" * n, 5) for n in range(1, 60)]
    frame = checkpoint(spark.createDataFrame(rows, "g string, item string, value bigint"))
    for few in (1, 20):
        got = {(r["g"], r["rank"]): r["item"] for r in divergence.top(frame, ["g"], 10, few).collect()}
        want = {(g, i): x for g in "ghe" for i, (_, _, x) in enumerate(sorted((-v, x.encode(), x) for z, x, v in rows if z == g)[:10], 1)}
        assert got == want


def test_shares_of_very_large_counts(spark):
    n, m, v = 3 * 10**12, 7 * 10**14, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(m), F.lit(v)).alias("x")).first()["x"]
    assert got == 1 + 10**9 * (n + 5) // (m + 5 * v)
