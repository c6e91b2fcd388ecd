"""Look-alikes, token ids, quality statistics and source mixing."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from postsieve.llm import encode, lookalike, mixture, quality
from postsieve.llm.queries import QUERIES

VOCAB = Path(encode.TOKENIZERS) / encode.DEFAULT
needs_vocab = pytest.mark.skipif(not VOCAB.exists(), reason="no public vocabulary")

SAME = [
    ("café", "café"), ("abc", "ａｂｃ"), ("first fly", "ﬁrst ﬂy"), ("a b", "a b"), ("across", "ac‌ross"), ("the", "thе"), ("⛵", "⛵️"), ("ёж", "ёж"), ("Tarnish", "Τarnish"), ("soft", "so­ft"), ("#x!", "＃x！"), ("a b", "a　b"),
]
OTHER = [("cafe", "café"), ("abc", "Abc"), ("o", "0"), ("a.", "a"), ("word", "words"), ("a b", "ab"), ("…", "..."), ("x²", "x2"), ("l", "1")]


def test_looks():
    n = lookalike.Normaliser({"the": 5, "на": 9, "first": 3})
    for a, b in SAME:
        assert lookalike.skeleton(n.text(a)) == lookalike.skeleton(n.text(b)), (a, b)
    for a, b in OTHER:
        assert lookalike.skeleton(n.text(a)) != lookalike.skeleton(n.text(b)), (a, b)
    # the automaton gives a token back its own script, the table alone would not
    assert n.token("нa") == "на" and lookalike.skeleton("на") == "нa" and n.token("thе") == "the" and n.text("ﬁrst thе") == "first the"


def test_same_look_pairs(spark):
    texts = [t for pair in SAME + OTHER for t in pair] + [None, "", "", "same", "same"]
    a = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "post_id int, text string, look string")
    b = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "record_id int, text string, raw string")
    got = {tuple(r) for r in lookalike.same_look(a, "post_id", b, "record_id").collect()}
    want = {(i, 100 + j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s and t and s != t and lookalike.skeleton(s) == lookalike.skeleton(t)}
    assert got == want and len(got) >= 2 * len(SAME)
    assert lookalike.same_look(a.limit(0), "post_id", b, "record_id").count() == 0


def test_the_trie_decides_letters_of_two_looks(spark):
    a = spark.createDataFrame([(1, "ӏt is late"), (2, "the ӏamp"), (3, "ν\u200bp there"), (4, "zӏzz")], "post_id int, text string")
    b = spark.createDataFrame([(1, "It is late"), (2, "the lamp"), (3, "up there"), (4, "zIzy")], "record_id int, text string")
    pairs = lambda **how: sorted(tuple(r) for r in lookalike.same_look(a, "post_id", b, "record_id", **how).collect())
    assert pairs() == [(1, 1), (2, 2), (3, 3)]
    assert pairs(counts={}) == [(2, 2)]  # the table alone knows one look


def test_the_automaton_counts_costs():
    t = lookalike.Trie({"lt": 1, "It": 9, "Ion": 4})
    assert (t.match("ӏt"), t.match("lt"), t.match("It"), t.match("ӏon"), t.match("lon"), t.match("1t"), t.match("")) == ("lt", "lt", "It", "Ion", None, None, None)


def test_pairs_of_a_hot_look_are_made_of_its_ways(spark):
    a = spark.range(3000).selectExpr("id AS post_id", "CASE WHEN id = 7 THEN 'hot te\u200bxt' ELSE 'hot text' END AS text")
    b = spark.range(3000).selectExpr("id AS record_id", "'hot text' AS text")
    assert lookalike.same_look(a, "post_id", b, "record_id").count() == 3000


def test_canonical_texts_are_equal_if_they_look_the_same(spark):
    # сор: three Cyrillic letters, commoner than the Latin word; рука and кот occur once, the latter also with a Latin letter
    texts = ["сор", "сор", "сор", "cop", "сoр", "рука", "кот", "кoт", "plain text", "plаin text", "=\u0338", "\u2260", "cafe\u0301", "caf\u00e9", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = dict(map(tuple, lookalike.normalise(d, "id", lookalike.vocabulary(d.select("text"))).collect()))
    assert [got[i] for i in range(10)] == ["сор"] * 5 + ["рука", "кот", "кот", "plain text", "plain text"]
    assert got[10] == got[11] and got[12] == got[13] and got[14] is None and got[15] == ""


def test_canonical_texts_decide_as_pairs_do(spark, sf):
    rows = QUERIES["p7_texts"](spark, sf).collect()
    text = {(r["tab"], r["id"]): r["text"] for r in rows}
    pairs = [tuple(r) for r in QUERIES["p7_found"](spark, sf).collect()]
    assert pairs and all(text["labeled_posts", a] == text["llm_labeled_posts", b] for a, b in pairs)


def test_all_texts_have_a_canonical_form(spark, sf):
    d = QUERIES["p7_texts"](spark, sf)
    assert d.count() == sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("labeled_posts", "llm_labeled_posts"))


@needs_vocab
def test_ids_are_those_of_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(VOCAB))
    t.encode_special_tokens = True
    r = random.Random(2)
    letters = "".join(map(chr, [*range(32, 127), *range(0xC0, 0x180), 0x4E2D, 0x1F600, 0x301, 0xA0, 9, 10, 13, 0x3000]))
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(150))) for _ in range(1500)]
    texts += ["<|endoftext|> x", "lol" * 20_000, " " * 30_000, "I'll it's we'RE", "a\n\n\n b", "1234567890 12", None, ""]
    e = encode.Encoder()
    assert e.vocab.sound.all()
    assert e.batch(texts) == [x.ids for x in t.encode_batch([s or "" for s in texts], add_special_tokens=False)]
    # both ways to the encoding are taken, and agree
    words = [w for s in texts if s for w in e.split(s) if len(w) < 40][:3000]
    assert 0 < e.n_exact
    assert all(e.vocab.exact(w.encode()) == ids for w, ids in e.words(list(dict.fromkeys(words))).items())


@needs_vocab
def test_ids_column(spark):
    d = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (1, "a b", 9)], "doc_id int, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.encode_column(d, "doc_id").collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])]
    assert encode.encode_column(d.limit(0), "doc_id").count() == 0
    assert sorted(r["n_tokens"] for r in encode.count_tokens(d, ["doc_id"]).collect()) == [0, 0, 2, 2]


PROSE = [
    "The parcel that a friend sent last week is still at the station.", "> I think the lamp in the hall is broken.\n> We should ask him about it.", "@ana12: have you seen the key?\n@bob7: it is on the table.", "so we went to the market and then it began to rain and nobody had a coat",
    "ich glaube, dass der Zug heute nicht mehr kommt.", "minha irmã gostaria de vender a bicicleta ontem à noite", "Ok.", "👍👍", "Thanks a lot!", "We bought three things for the house and they were all cheap.\nIt was a good day for us.\n- milk\n- bread",
]
JUNK = [
    "- red lamp\n- old chair\n* new table\n- small box", "term,class,count\nlamp,safe,12\nchair,unsafe,3\nbox,safe,9", "| a | b |\n| --- | --- |\n| lamp | 3 |\n| box | 4 |", "Home · About · Login · Help · Terms · Home", "https://a.example/x1\nhttps://a.example/x2\nhttps://a.example/x3",
    "[12] WARN 0x1a retry=3 q=1\n[13] WARN 0x1b retry=4 q=2", "lol" * 60, "free free free free free box free free", "qwj skd; lkj asdk qpw zxm vbn;k wer", "#redlamp #oldchair #newtable #bigbox", "Âroro Ã©bibi â€™sisi Ã¼riri", "lamp\tsafe\t12\nchair\tunsafe\t4",
    '{"term": "lamp", "count": 3}\n{"term": "box", "count": 4}', "Please read this list.\n" + "\n".join(f"- item{i} thing{i}" for i in range(30)), "XjODU89sQNSSpYXsh2M6+8+w9YCNXxHeNbyH0Rr1TD/ECgEDV74mY9OWk2iKs2==",
]


def test_quality_verdicts(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*PROSE, *JUNK, None, "", " \t　"])], "doc_id int, text string, lines string")
    v = {r["doc_id"]: r for r in quality.verdicts(quality.statistics(d)).collect()}
    assert [i for i in range(len(PROSE)) if v[i]["rejected"]] == []
    assert [t for i, t in enumerate(JUNK, len(PROSE)) if not v[i]["rejected"]] == []
    for i in range(len(PROSE) + len(JUNK), len(v)):
        assert not v[i]["rejected"] and v[i]["reasons"] == [] and v[i]["n_words"] == 0 and v[i]["sentence_share"] is None
    assert all(r["rejected"] == bool(set(r["reasons"]) - {"ellipses", "few_ended_lines", "few_words"}) for r in v.values())


@pytest.mark.parametrize(
    "text, reason",
    [
        ("lamp chair table box " * 4, "stop_words"),
        ("lol" * 60, "word_length"),
        ("#the #old #lamp is #on it", "hashes"),
        ("- the lamp of it\n- the old one\n- and that is it", "bullets"),
        ("the 12 of 3 is 44", "letter_words"),
        ("it is the lamp\nit is the lamp\nwe had it\nand it was so", "repeated_lines"),
        ("the the the the lamp the the the the the old the the the", "repeated_words"),
        ("it is https://links.example/a-very-long-address/of-some-place", "links"),
        ("=-=-=-=-=-=-=-", "no_words"),
    ],
)
def test_a_reason_per_rule(spark, text, reason):
    v = quality.verdicts(quality.statistics(spark.createDataFrame([(1, text)], "doc_id int, text string"))).first()
    assert v["rejected"] and reason in v["reasons"]


def test_quality_counts(spark):
    d = spark.createDataFrame([(1, "The cat, it sat.\n\n- a dog 42"), (2, "word " * 50_000)], "doc_id int, text string")
    r = {x["doc_id"]: x for x in quality.statistics(d).collect()}
    assert (r[1]["n_words"], r[1]["n_lines"], r[1]["ended_line_share"], r[1]["bullet_share"], r[1]["letter_word_share"]) == (7, 2, 0.5, 0.5, 0.8571)
    twice = quality.statistics(spark.createDataFrame([(1, "A\n  b\n b\nc")], "doc_id int, text string")).first()
    assert (twice["repeated_line_share"], twice["repeated_char_share"]) == (0.25, 0.25)
    assert r[2]["n_words"] == 50_000 and r[2]["n_chars"] == 250_000
    assert quality.verdicts(quality.statistics(d.limit(0))).count() == 0


def sized(spark, docs):
    return spark.createDataFrame(docs, "doc_id int, source string, n_tokens bigint")


def test_mixture(spark):
    docs = [(i, "big", 10) for i in range(1000)] + [(1000 + i, "small", 10) for i in range(20)] + [(2000, "big", 0), (2001, None, 10), (2002, "other", 10)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    m, plan = mixture.mix(sized(spark, docs), targets)
    rows = m.orderBy("position").collect()
    # small can give 600 tokens at weight 4/9: the budget is 1350
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1)) and 1330 <= sum(r["n_tokens"] for r in rows) <= 1350
    uses = {}
    for r in rows:
        uses.setdefault(r["doc_id"], []).append(r["use"])
    assert all(u == sorted(set(u)) for u in uses.values()) and max(map(len, uses.values())) == 3
    half = rows[: len(rows) // 2]
    assert abs(sum(r["source"] == "big" for r in half) / len(half) - 5 / 9) < 0.03  # fair at any moment
    s = {r["source"]: r for r in mixture.shares(m, plan).collect()}
    assert s["none"]["actual_share"] == 0 and abs(s["big"]["actual_share"] - 5 / 9) < 0.01 and s["small"]["most_uses"] == 3 and s["zero"]["used_docs"] == 0
    small, _ = mixture.mix(sized(spark, docs), targets, budget=100)
    assert 80 <= sum(r["n_tokens"] for r in small.collect()) <= 100


def test_mixture_is_the_same_in_many_buckets(spark, monkeypatch):
    docs = [(i, "ab"[i % 3 == 0], 1 + i % 7) for i in range(500)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    one = [tuple(r) for r in mixture.mix(sized(spark, docs), targets)[0].orderBy("position").collect()]
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 7)
    many = [tuple(r) for r in mixture.mix(sized(spark, docs), targets)[0].orderBy("position").collect()]
    total = lambda rows: sum(r[4] for r in rows)
    assert [r[0] for r in many] == list(range(1, len(many) + 1)) and abs(total(one) - total(many)) <= 14


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixture.mix(sized(spark, []), targets)[0].count() == 0
    assert mixture.mix(sized(spark, [(1, "a", 5)]), targets.limit(0))[0].count() == 0
