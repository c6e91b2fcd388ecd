"""Copies and near-duplicates: edge cases, SQL and brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from postsieve.llm import dupes, nearup
from postsieve.llm.queries import ORACLES, QUERIES, posts

from ..oracle import same

ROWS = [
    ("a", 1, "Hello, world"),
    ("a", 2, "hello world!!"),
    ("a", 3, "HELLO  WORLD 🌵"),
    ("b", 4, "hello world"),
    ("a", 5, None),
    ("a", 6, ""),
    ("a", 7, "  \t"),
    ("a", 8, "name: x | tone: y; place: z"),
    ("a", 9, "place: z|tone: y|name: x"),
    ("a", 10, "tone: y | place: z"),
    ("a", 11, "Hello, world"),
    ("a", 12, "..."),
    ("a", 13, "!?"),
    ("a", 14, "x" * 100_000 + "!"),
    ("a", 15, "X " * 100_000),
    ("a", 16, "café"),
    ("a", 17, "cafe"),
    ("a", 18, "name: x ; tone: y ; place: z"),
    ("a", 19, "name x tone y place z"),
]
WANT = [("a", 1, 2), ("a", 1, 11), ("a", 8, 9), ("a", 8, 18), ("a", 12, 13), ("a", 14, 15)]


@pytest.mark.parametrize("hot", [1, 2, 50_000])
def test_copies(spark, hot):
    d = spark.createDataFrame([(*r, "clash", 0) for r in ROWS], "tab string, id int, text string, class string, s int")
    got = sorted(map(tuple, dupes.copies(d, hot).collect()))
    # 19 equals 18 after dropping punctuation, as ; is punctuation, so it joins that group
    assert got == sorted([*WANT, ("a", 8, 19)])


def plain_copies(rows):
    """The definition of copies, row by row."""
    import unicodedata

    drop = lambda t: "".join(c for c in t.lower() if not c.isspace() and unicodedata.category(c)[0] != "P")
    groups, plain = {}, {}
    for tab, i, t in sorted((r for r in rows if r[2] and r[2].strip()), key=lambda r: r[1]):
        parts = t.replace("|", ";").split(";")
        record = len(parts) >= 3 and all(":" in x and x.split(":")[0].strip().isalpha() for x in parts)
        key = ("record", *sorted(map(drop, parts))) if record else ("text", drop(t))
        if record:
            plain.setdefault((tab, drop(t)), key)
        groups.setdefault((tab, key), []).append((i, drop(t)))
    for (tab, key), members in list(groups.items()):
        if key[0] == "text" and (tab, key[1]) in plain:
            groups[tab, plain[tab, key[1]]] += groups.pop((tab, key))
    return sorted((tab, min(m)[0], i) for (tab, _), m in groups.items() for i, _ in m if i != min(m)[0])


def test_white_space_of_any_kind_around_names(spark):
    rows = [("a", k, t) for k, t in enumerate(["name: x | tone: y; place: z", "place\u00a0: z|\u2009tone: y|\u3000name\u2003: x", "\u0085tone: y;place: z\x1c; name: x", "na me: q | tone: y; place: z", "place: z | tone: y; na me: q", "a: 1 | b: 2 |", "b: 2 | a: 1 |"])]
    d = spark.createDataFrame(rows, "tab string, id int, text string")
    got = sorted(map(tuple, dupes.copies(d).collect()))
    assert got == [("a", 0, 1), ("a", 0, 2)] == plain_copies(rows)


def test_copies_as_defined(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/combined.parquet").selectExpr("'combined' AS tab", "row_id AS id", "text")
    assert sorted(map(tuple, dupes.copies(d).collect())) == plain_copies([tuple(r) for r in d.collect()])


def test_copies_of_one_hot_text(spark):
    d = spark.range(5000).selectExpr("'t' AS tab", "id", "concat(repeat(' ', int(id % 7)), 'SAME text') AS text")
    assert dupes.copies(d, 100).count() == 4999
    assert dupes.copies(d).count() == 4999
    assert dupes.group_sizes(dupes.copies(d)).first()["n_rows"] == 5000


def test_copies_of_nothing(spark):
    assert dupes.copies(spark.createDataFrame([], "tab string, id int, text string")).count() == 0


@pytest.mark.parametrize("hot", [1, 2, 50_000])
def test_one_record_per_content(spark, hot):
    d = spark.createDataFrame([(*r, "clash", 0) for r in [*ROWS, ("a", None, "hello world")]], "tab string, id int, text string, class string, s int")
    got = sorted(map(tuple, dupes.contents(d, hot).collect()))
    assert got == [("a", 1, 3), ("a", 3, 1), ("a", 8, 4), ("a", 10, 1), ("a", 12, 2), ("a", 14, 2), ("a", 16, 1), ("a", 17, 1), ("b", 4, 1)]
    assert dupes.contents(d.limit(0), hot).count() == 0


def test_contents_as_sql(spark, sf):
    same(spark, sf, QUERIES["p2_contents"], ORACLES["p2_contents"])


@pytest.mark.parametrize("name", ["p2_found", "p2_groups", "p3_found", "p3_classes", "p7_found", "p10_found", "p10_stats"])
def test_copies_as_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])


def brute(rows, copy, threshold=0.6):
    sets = {}
    for i, t in rows:
        w = nearup.words_of(t or "")
        if len(w) >= nearup.MIN_WORDS:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {
        (min(a, b), max(a, b))
        for a, b in combinations(sets, 2)
        if 10 * len(sets[a] & sets[b]) >= 10 * threshold * len(sets[a] | sets[b]) and copy[a] != copy[b]
    }


def test_near_pairs_by_brute_force(spark, sf):
    from pyspark.sql import functions as F

    p = posts(spark, sf)
    rows = [(r[0], r[1]) for r in p.collect()]
    copy = {r[0]: r[1] for r in p.select("id", dupes.canonical(F.col("text"))).collect()}
    assert {tuple(r) for r in QUERIES["p3_found"](spark, sf).collect()} == brute(rows, copy)


def test_near_edges(spark):
    w = [f"w{i}" for i in range(30)]
    texts = [" ".join(w), " ".join(w[:-2]), " ".join(w) + " 🌵", " ".join(w) + "!", None, "", "short text", " ".join(w[:19]), " ".join(w[::-1]), " ".join(w * 3000), " ".join(w * 3000) + " tail"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id int, text string, cls int, copy int")
    got = {tuple(r) for r in nearup.near_pairs(d, dupes.canonical).collect()}
    # 0 and 3 are copies; 2 has another emoji; 9 and 10 share all but the last shingle, and hold all of 0's
    assert {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (9, 10)} <= got and (0, 3) not in got and not any(8 in p or 7 in p for p in got)
    assert nearup.near_pairs(d.limit(0), dupes.canonical).count() == 0
    c = {r["id"]: r for r in nearup.near_classes(d).collect()}
    assert set(c) == {0, 1, 2, 3, 8, 9, 10} and c[0]["cls"] == c[2]["cls"] == c[3]["cls"] and c[8]["n_links"] == 0 and c[1]["n_links"] >= 1


def test_a_hot_text_makes_no_pairs_of_copies(spark):
    w = " ".join(f"w{i}" for i in range(25))
    d = spark.range(3000).selectExpr("id", f"CASE WHEN id = 7 THEN '{w} 🌵' ELSE concat('{w}', repeat('!', int(id % 5))) END AS text")
    assert nearup.near_pairs(d, dupes.canonical).count() == 2999


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(8)
    chain = [int(x) for x in rng.permutation(300)]
    pairs = [*zip(chain, chain[1:]), *((1000, k) for k in range(1001, 1050)), *((int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2)) if a != b)]
    want = union_find({x for p in pairs for x in p}, pairs)
    got = dict(map(tuple, nearup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == {n: r for n, r in want.items() if n != r}
    assert nearup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_groups(spark):
    w = [f"w{i}" for i in range(60)]
    v = [f"v{i}" for i in range(30)]
    # 2, 4 and 7 are a chain: the ends share less than most of their content
    texts = {2: " ".join(w[:40]), 4: " ".join(w[5:48]), 7: " ".join(w[14:55]), 9: " ".join(w[:40]) + "!", 11: " ".join(v), 12: " ".join(v[1:]), 13: None, 14: "short", 15: "short", 16: " ".join(f"u{i}" for i in range(25))}
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()] + [(None, " ".join(w[:40]), 1, 2)], "id int, text string, cls int, copy int")
    got = {r["id"]: r for r in nearup.near_groups(d).collect()}
    assert {i: r["cls"] for i, r in got.items()} == {2: 2, 4: 2, 7: 2, 9: 2, 11: 11, 12: 11, 13: 13, 14: 14, 15: 15, 16: 16}
    assert got[16]["n_links"] == 0 and got[13]["n_links"] == 0 and got[4]["n_links"] == 2
    assert nearup.near_groups(d.limit(0)).count() == 0


def test_groups_of_all_posts(spark, sf):
    pairs = [tuple(r) for r in QUERIES["p3_found"](spark, sf).collect()]
    got = {r["id"]: r["cls"] for r in QUERIES["p3_classes"](spark, sf).collect()}
    assert len(got) == posts(spark, sf).count() and all(c <= i for i, c in got.items())
    assert all(got[a] == got[b] for a, b in pairs) and len(pairs) > 10


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])  # similarity 0.6
    sig = nearup.signatures(np.concatenate([a, b]), np.array([0, 400]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(nearup.permute(x))) == 1 << 16


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], set()
    for k in range(150):  # 60 words; two changed runs leave a similarity of 0.6 or a little more
        w = [f"q{k}_{i}" for i in range(60)]
        v = list(w)
        for i in sorted(rng.choice(np.arange(2, 50), size=12, replace=False))[:4]:
            v[i] = "other"
        a, b = set(zip(w, w[1:], w[2:])), set(zip(v, v[1:], v[2:]))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        if len(a & b) / len(a | b) >= 0.6:
            truth.add((2 * k, 2 * k + 1))
    d = spark.createDataFrame(rows, "id int, text string")
    got = {tuple(r) for r in nearup.near_pairs(d, dupes.canonical).collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth) > 50
