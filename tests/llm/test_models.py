"""Trained operators: held-out accuracy on composed texts, and edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from postsieve.llm import boost, language, pii, pii_texts, toxic
from postsieve.llm.queries import QUERIES

SENTENCES = {
    "en": "the train was late again and nobody said why|we should ask him about the house before winter|she has never been to the sea with her friends",
    "de": "der Zug war schon wieder zu spät und niemand sagte warum|wir sollten ihn vor dem Winter nach dem Haus fragen|sie war noch nie mit ihren Freunden am Meer",
    "fr": "le train était encore en retard et personne n'a dit pourquoi|nous devrions lui parler de la maison avant l'hiver|elle n'est jamais allée à la mer avec ses amis",
    "es": "el tren llegó tarde otra vez y nadie dijo por qué|deberíamos preguntarle por la casa antes del invierno|ella nunca ha ido al mar con sus amigos",
    "pt": "o trem atrasou outra vez e ninguém disse por quê|devíamos perguntar a ele sobre a casa antes do inverno|ela nunca foi ao mar com os seus amigos",
    "nl": "de trein was weer te laat en niemand zei waarom|we moeten hem voor de winter over het huis vragen|zij is nog nooit met haar vrienden naar zee geweest",
}


@pytest.fixture(scope="module")
def crf(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/combined.parquet").selectExpr("row_id AS id", "text", "lang")
    return language.train(language.training_sample(d))


def test_sample_is_bounded(spark):
    d = spark.range(3000).selectExpr("id", "'the house is here' AS text", "CASE WHEN id % 3 = 0 THEN 'EN-us' WHEN id % 3 = 1 THEN 'xx' ELSE 'de' END AS lang")
    s = language.training_sample(d, 50)
    assert {x[1] for x in s} == {"en", "de"} and len(s) < 200


def test_languages_of_new_sentences(crf):
    d = language.Decoder(crf)
    texts = [(k, s) for k, v in SENTENCES.items() for s in v.split("|")]
    got = d.batch([s for _, s in texts])
    assert sum(len(g) == 1 and g[0][0] == k for (k, _), g in zip(texts, got)) >= len(texts) - 1


def test_mixed_texts_and_edges(crf):
    r, d = random.Random(4), language.Decoder(crf)
    right = 0
    cases = []
    for _ in range(60):
        a, b = r.sample(list(SENTENCES), 2)
        cases.append(([a, b], r.choice(SENTENCES[a].split("|")) + r.choice((". ", "\n", " -- ")) + r.choice(SENTENCES[b].split("|"))))
    right = sum([s[0] for s in g] == want for (want, _), g in zip(cases, d.batch([t for _, t in cases])))
    assert right >= 54
    assert d.batch([None, "", " \n", "🌵🌵", "https://a.example/b @someone #tag 12", "the"])[:5] == [[], [], [], [], []]
    one = d.batch(["we lost the Rucksack again in the house and nobody knows where"])[0]
    assert [s[0] for s in one] == ["en"] and 0 < one[0][1] <= 1
    assert d.batch(["the house and the " * 40_000])[0][0][0] == "en"


def test_short_segments_that_are_sure(crf):
    d = language.Decoder(crf)
    got = d.batch(["we asked them about the house before winter. você não é", "Eres un i-d-i-o-t-a asqueroso y nadie te quiere", "we lost the Rucksack again in the house"])
    assert [[s[0] for s in g] for g in got] == [["en", "pt"], ["es"], ["en"]]


def test_language_labels(spark, crf):
    rows = [(1, "the house is near the old station", "en-GB"), (2, "the house is near the old station", "DE"), (3, "the house is near the old station", None), (4, "the house is near the old station", " EN "), (5, None, "en"), (6, "the house is near the old station", "und")]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "id int, text string, lang string, n_words int, language string")
    assert sorted(r["id"] for r in language.mislabelled(language.segments(d, crf)).collect()) == [2, 3, 6]
    assert language.segments(d.limit(0), crf).count() == 0
    assert language.training_sequences([]) == [] and language.Decoder(language.train([])).batch(["abc"])[0][0][2] == 1


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    crf = language.Crf()
    crf.move, crf.start = rng.normal(size=(6, 6)).astype(np.float32), rng.normal(size=6).astype(np.float32)
    emit = rng.normal(size=(1, 3, 6)).astype(np.float32)
    m, _, _ = crf.marginals(emit, np.array([3]))
    want = np.zeros((3, 6))
    for a in range(6):
        for b in range(6):
            for c in range(6):
                w = math.exp(crf.start[a] + emit[0, 0, a] + crf.move[a, b] + emit[0, 1, b] + crf.move[b, c] + emit[0, 2, c])
                want[0, a] += w
                want[1, b] += w
                want[2, c] += w
    assert np.allclose(m[0], want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_maximal_segments_by_brute_force():
    r = random.Random(3)
    for _ in range(200):
        s = [round(r.uniform(-2, 1.6), 2) for _ in range(r.randrange(1, 14))]
        best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert abs(toxic.best_segment(s) - best) < 1e-9
        segs = toxic.maximal_segments(s)
        assert not segs and best == 0 or abs(max(x[2] for x in segs) - best) < 1e-9
        assert all(a < b and abs(sum(s[a:b]) - x) < 1e-9 for a, b, x in segs) and all(p[1] <= q[0] for p, q in zip(segs, segs[1:]))


def test_segments_in_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        s = [1.0 if i % 2 else -0.999 - i * 1e-9 for i in range(n)]
        began = time.perf_counter()
        assert toxic.maximal_segments(s)
        toxic.maximal_segments([1.0, -1.1] * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_several_passages_count_together():
    law = toxic.Calibration({}, 0, 0, [])
    law.scale, law.k = 1.0, 0.1
    one, two, three = (law.together([11.0] * r, 30)[0] for r in (1, 2, 3))
    assert one > two > three and law.together([11.0, 0.5, 0.1], 30) == law.together([11.0], 30)
    assert law.together([], 30) == (1.0, 0) and law.together([11.0] * 3, 30)[1] == 3
    # simulated background: no sum is more significant than it should be
    r = random.Random(5)
    seen = [law.together([x for _, _, x in toxic.maximal_segments([r.choice((-1.0, -1.0, 0.7)) for _ in range(200)])], 200)[0] for _ in range(400)]
    assert sum(p <= 0.01 for p in seen) <= 12


def test_long_tokens_are_whole():
    word = "a" * 300 + "." + "b" * 300
    assert toxic.tokens_of(f"x {word} y") == ["x", word, "y"] and toxic.tokens_of("#" * 100_000) == [] and toxic.tokens_of("a" + "!" * 100_000) == ["a"]
    assert toxic.tokens_of("$tupid ### f#ck! #") == ["$tupid", "f#ck"]


def test_folding():
    f = lambda t: [toxic.fold(x) for x in toxic.tokens_of(t)]
    assert f("You are s.t.u.p.i.d and b r a i n l e s s!") == ["you", "are", "stupid", "and", "brainless"]
    assert f("a w0rthle$s cr33p") == ["a", "worthless", "creep"] and f("n*ked") == ["n?ked"] and f("at 12 https://a.example/x @someone #tag") == ["at", "<num>"]
    assert f("") == [] and f("don't") == ["don't"]


@pytest.fixture(scope="module")
def judge(spark):
    r = random.Random(8)
    fill = "lamp table window garden yellow quiet old bought carried near under".split()
    line = lambda: " ".join(r.choice(fill) for _ in range(8))
    rows = []
    for i in range(1500):
        bad = i % 4 == 0
        text = line() + (f" you are a stupid {r.choice(('moron', 'creep'))} and everyone knows it " if bad else " someone said moron and that is not ok ") * (r.random() < 0.9) + line()
        rows.append((text, ("unsafe" if bad else "safe") if r.random() < 0.95 else None if r.random() < 0.3 else "safe"))
    return toxic.Model(spark.createDataFrame(rows + [(None, "safe"), ("", "unsafe")], "text string, class string"))


def test_scores(spark, judge):
    bad, ok = judge.judge("old lamp you are a stupid moron and everyone knows it quiet garden"), judge.judge("someone said moron and that is not ok near the old lamp")
    assert bad[1] <= toxic.ALPHA < ok[1]
    assert judge.judge("you are a st*pid m0ron and everyone knows it")[1] <= toxic.ALPHA
    assert judge.judge(None) == (0, 1.0, []) and judge.judge("  ")[1] == 1.0
    assert "moron" in judge.passages("old lamp you are a stupid moron and everyone knows it quiet garden")[0]
    d = spark.createDataFrame([("t", 1, None, 0.1), ("t", 2, "you are a stupid moron and everyone knows it", 0.1)], "tab string, row_id int, text string, score double")
    assert [r["p_value"] <= toxic.ALPHA for r in toxic.score(d, judge, ["tab", "row_id"]).orderBy("row_id").collect()] == [False, True]
    assert toxic.score(d.limit(0), judge, ["tab", "row_id"]).count() == 0


def test_model_without_labels(spark):
    m = toxic.Model(spark.createDataFrame([], "text string, class string"))
    assert m.judge("hello there")[1] == 1.0


def test_toxic_agrees_with_labels(spark):
    """The labels are noisy; what is flagged must mostly carry the unsafe label."""
    sf = "/root/testdata/sf0.01"
    d = QUERIES["p5_found"](spark, sf).where("tab = 'hatebase_cleaned'").join(spark.read.parquet(f"{sf}/hatebase_cleaned.parquet").selectExpr("tweet_id AS row_id", "class"), "row_id")
    n = {r["class"]: r["count"] for r in d.groupBy("class").count().collect()}
    assert n["unsafe"] > 5 * n.get("safe", 0)


def test_no_term_is_dropped_in_silence(spark):
    lexicon = spark.range(12_000).selectExpr("concat('term', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS term", "'an insult' AS meaning")
    assert len(set(toxic.harmful_terms(lexicon))) == 12_000
    with pytest.raises(ValueError):
        toxic.harmful_terms(lexicon, 11_999)
    counts = spark.createDataFrame([(f"w{i}", 0, 500) for i in range(20)] + [(f"v{i}", 500, 0) for i in range(20)], "term string, safe bigint, unsafe bigint")
    n = len(toxic.log_odds(counts, []))
    assert n >= 40 and len(toxic.log_odds(counts, [], n)) == n
    with pytest.raises(ValueError):
        toxic.log_odds(counts, [], n - 1)


@pytest.fixture(scope="module")
def finder():
    return pii.Model()


def test_pii_on_held_out_texts(finder):
    texts = pii_texts.compose(1500, seed=99, common=finder.lexicon.plain())
    got = [{(pii.TYPES[k], t[s:e]) for k, s, e, _ in spans} for (t, _), spans in zip(texts, finder.select([t for t, _ in texts]))]
    for name in pii.TYPES:
        want = [{x for x in g if x[0] == name} for _, g in texts]
        have = [{x for x in g if x[0] == name} for g in got]
        tp = sum(len(a & b) for a, b in zip(want, have))
        assert tp / sum(map(len, want)) > 0.9 and tp / sum(map(len, have)) > 0.9, name


def test_pii_redaction(spark, finder):
    rows = [
        (1, "my name is Marek Vandersen and i sold it. write to m.vand@mail.example about it!"),
        (2, "Order 9571564447 shipped, tracking RB300815511. From 1904 to 2008 the Velvet Anchors played. isbn 978-0-49437-441-5 is out of print."),
        (3, None),
        (4, ""),
        (5, "call +44 20 7946 0272 after lunch. she lives at Thornmoorstraße 36a behind it | someone posted my passport ZZ4198500 in the thread"),
        (6, "anton posted at 11:14 again. the score was 3-2 on Quill Street."),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "id int, text string, pii int")
    got = {r["id"]: r for r in pii.redacted(d, finder).collect()}
    assert got[1]["text"] == "my name is [NAME] and i sold it. write to [EMAIL] about it!"
    assert got[2]["text"] == rows[1][1] and got[3]["text"] is None and got[4]["text"] == "" and got[6]["n_pii"] == 0
    assert got[5]["text"] == "call [PHONE] after lunch. she lives at [ADDRESS] behind it | someone posted my passport [ID_NUMBER] in the thread"
    assert {tuple(r) for r in pii.find(d, finder).where("id = 1").collect()} == {(1, "name", "Marek Vandersen"), (1, "email", "m.vand@mail.example")}
    assert pii.find(d.limit(0), finder).count() == 0
    assert len(finder.select(["word " * 100_000 + "call 555-0123 now"])[0]) == 1


@pytest.mark.parametrize(
    "text, phone",
    [
        ("call 555-1234 2nd floor", "555-1234"),
        ("ring 0612 345678 4pm please", "0612 345678"),
        ("text +44 20 7946 0958 3x a day", "+44 20 7946 0958"),
        ("call 1-800-555-0199 24h", "1-800-555-0199"),
        ("call 0612345678 2024-05-01", "0612345678"),
        ("on 2024-05-01 0612 345678", "0612 345678"),
        ("call +44 20 7946 0958 after lunch", "+44 20 7946 0958"),
    ],
)
def test_phones_beside_numbers(finder, text, phone):
    assert phone in {text[s:e] for k, s, e in pii.propose(text) if k == 1}
    assert [text[s:e] for _, s, e, _ in finder.select([text])[0]] == [phone]


@pytest.mark.parametrize(
    "text, email",
    [
        ("write to j.doe at mail.com please", "j.doe at mail.com"),
        ("J.DOE [AT] MAIL [DOT] COM", "J.DOE [AT] MAIL [DOT] COM"),
        ("my mail is j.doe [AT] mail [DOT] org", "j.doe [AT] mail [DOT] org"),
        ("write j.doe[AT]mail.com", "j.doe[AT]mail.com"),
        ("j.doe {at} mail {dot} com", "j.doe {at} mail {dot} com"),
        ("look at j.doe at mail.com", "j.doe at mail.com"),
        ("look at example.com for it", None),
        ("we were at home.then it rained", None),
        ("order at shop.example.com today", None),
    ],
)
def test_emails_in_written_forms(finder, text, email):
    assert email is None or email in {text[s:e] for k, s, e in pii.propose(text) if k == 0}
    assert [text[s:e] for _, s, e, _ in finder.select([text])[0]] == [email][: email is not None]


def test_the_gate_of_addresses_is_no_narrower():
    for at, dot in ((a, d) for a in ("@", " @ ", " at ", "\tAT\n", "[at]", " { At } ", "(AT)") for d in (".", " dot ", "[DOT]", " {dot} ")):
        text = f"j.doe{at}mail{dot}com"
        assert (0, 0, len(text)) in pii.propose(text)


def test_short_addresses_late_in_a_long_text():
    text = "12 rue Mori Tal Ken. " * 6000 + "7 rue Valmer now here"
    at = text.index("7 rue")
    assert {text[s:e] for k, s, e in pii.propose(text) if k == 3 and s == at} == {"7 rue Valmer now here", "7 rue Valmer now", "7 rue Valmer"}


def test_without_vocabularies():
    m = pii.Model(texts=1500, names=500, vocabularies=())
    assert not m.lexicon.common and {(k, t) for t in ("write to m.vand@mail.example about it", "nothing is here") for k, *_ in m.select([t])[0]} == {(0, "write to m.vand@mail.example about it")}


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    b = boost.Boosted().fit(x[:1500], y[:1500])
    assert ((b.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


@pytest.mark.parametrize("name", ["p4_found", "p5_rates", "p6_found", "p8_ids", "p9_shares", "p10_stats"])
def test_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
