"""Hand-derived cases of the screening, matching, labelling, export and streaming operators."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsieve.functions import text as T
from postsieve.operators import dedupe, export, inference, labels, matching, profile, screening
from postsieve.plans.reference_queries import stub_labeler
from postsieve.sources import files, writers
from postsieve.streaming import collector

LEXICON = [(1, "un-alive", "suicide"), (2, "unalive", "killing time"), (3, "🌽️", "porn"), (4, "leaf", "weed"), (5, "abc", "letters"), (6, "blep", None), (7, "ＡＢＣ", "sex")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "term_ord int, term string, meaning string")


def label_of(spark, lexicon, *texts, inline=256):
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    r = labels.label_posts(d, "id", lexicon).orderBy("id").collect()
    return [(x["label"], x["confidence"], x["reasons"][0]) for x in r]


def test_labels(spark, lexicon):
    got = label_of(
        spark, lexicon, "that is racist", "they will expose it", "CLICK  here", "expose it, click here", "a leaf", "abc", "good morning", "homophobia is bad", None, "", "I’ll stab", "énude", "nude", "kill myself xxx"
    )
    assert got == [
        ("moderated", 0.95, "moderation-hit:hate"),
        ("questionable", 0.75, "moderation-hit:harassment"),
        ("questionable", 0.60, "moderation-hit:spam"),
        ("questionable", 0.75, "moderation-hit:harassment"),
        ("questionable", 0.80, "coded-harmful:coded"),
        ("questionable", 0.80, "coded-harmful:sexual"),  # the later of two terms equal after normalisation
        ("clean", 0.90, "no-hits"),
        ("clean", 0.90, "no-hits"),
        ("clean", 0.90, "no-hits"),
        ("clean", 0.90, "no-hits"),
        ("moderated", 0.95, "moderation-hit:threats"),
        ("clean", 0.90, "no-hits"),
        ("moderated", 0.95, "moderation-hit:sexual"),
        ("moderated", 0.95, "moderation-hit:self_harm"),
    ]


# "un-alive" allows separators, "unalive" does not; ABC stands twice, both with the later meaning
WANT_TOKENS = [["un-alive"], ["un-alive", "unalive"], ["un-alive"], [], ["abc", "ABC"], ["🌽"], [], [], ["un-alive", "unalive", "leaf"]]


@pytest.mark.parametrize("inline", [0, 256])
def test_coded_terms(spark, lexicon, inline):
    texts = ["un alive", "unalive", "un_alive", "éabc", "abc", "🌽 corn", "x", None, "unalive leaf"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    r = matching.match_posts(d, "id", lexicon, inline).orderBy("id").collect()
    assert [[h["token"] for h in x["coded_hits"]] for x in r] == WANT_TOKENS


@pytest.mark.parametrize("inline", [0, 256])
def test_capped_hits(spark, lexicon, inline):
    d = spark.createDataFrame([(1, "abc leaf unalive blep"), (2, "none"), (3, None), (4, "abc leaf unalive blep")], "id int, text string")
    got = {r["id"]: [h["token"] for h in r["hits"]] for r in matching.with_capped_hits(d, lexicon, 2, inline).collect()}
    assert got == {1: ["unalive", "leaf"], 2: [], 3: [], 4: ["unalive", "leaf"]}


GARBAGE = {
    "https://x.y/z": "address", "@someone": "handle", "@élan": "handle", "aaaaa": "repeated", "aaaa": None, "🌽🌽🌽🌽🌽": "repeated", "555-12 34": "digits", "²³": "digits", "!!!?": "symbols", "🌽": None,
    "abc": "short", "abcd": None, "": "empty", "  \x1c": "empty", "..//@@.com": "broken_address", "see example.com now": None, "🌽!!!": None,
}


def test_screening(spark):
    d = screening.with_garbage_rule(spark.createDataFrame([(k, v) for k, v in GARBAGE.items()], "text string, want string"), name="got")
    assert [(r["text"], r["got"]) for r in d.collect()] == list(GARBAGE.items())
    assert screening.with_garbage_rule(spark.createDataFrame([(None,)], "text string")).first()["rule"] == "empty"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_text_functions_match_python(spark, texts):
    texts = [t for t in texts if not any("\ud800" <= c <= "\udfff" for c in t)] or ["a"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    r = d.select("i", T.strip(F.col("t")).alias("s"), T.content_hash(F.col("t")).alias("h"), T.normalise_fold("t").alias("n")).orderBy("i").collect()
    import hashlib

    assert [x["s"] for x in r] == [t.strip() for t in texts]
    assert [x["h"] for x in r] == [hashlib.sha1(t.encode()).hexdigest() for t in texts]
    assert [x["n"]["folded"] for x in r] == [T.normalised(t).casefold() for t in texts]


def test_probes_are_in_every_match():
    assert T.probes(r"\b(kms|ctb)\b") == ["kms", "ctb"]
    assert T.probes(r"\b(kill\s+myself|end\s+it\s+all|suicid(e|al)|doxx?)\b") == ["myself", "end", "suicid", "dox"]
    assert T.probes(r"\b(i\s*(will|['’]?ll)\s*(kill|hurt))\b") == ["kill", "hurt"]
    assert T.probes(r"\brip\s+your\b") == ["your"] and T.probes(r"\b[ab]\b") is None


def test_dedupe(spark):
    d = spark.createDataFrame([(1, "A "), (2, "a"), (3, None), (4, "none"), (5, "b"), (6, None)], "id int, text string")
    key = dedupe.loose_key(F.col("text"))
    assert sorted(r["id"] for r in dedupe.keep_first(d, key, "id").collect()) == [1, 3, 5]
    assert sorted(r["id"] for r in dedupe.repeated_rows(d, key).collect()) == [1, 2, 3, 4, 6]
    assert dedupe.excess_rows(d, key).first()[0] == 3
    assert dedupe.excess_rows(d.limit(0), key).first()[0] == 0


def test_resume(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id int, text string")
    done = spark.createDataFrame([("a", "yes"), ("c", "error")], "text string, is_coded string").withColumn("hash", T.content_hash(F.col("text")))
    assert sorted(r["id"] for r in dedupe.pending(posts, done, "id").collect()) == [2, 4]
    assert sorted(r["id"] for r in dedupe.pending(posts, done, "id", legacy=True).collect()) == [1, 2, 4]


def test_answer_policy(spark):
    rows = [("no", "hate", "masking", 0.5, ["x"]), ("yes", "hate", "masking", 0.65, ["x"]), ("unsure", "hate", "masking", 0.9, ["x"]), ("no", "hate", "masking", 0.9, None)]
    d = spark.createDataFrame(rows, "is_coded string, domain string, mechanism string, confidence double, decoded array<string>")
    got = [tuple(r) for r in labels.answer_policy(d).select("domain", "mechanism", "decoded", "needs_review", "bucket").collect()]
    assert got == [("none", "other", [], True, "review"), ("hate", "masking", ["x"], False, "yes"), ("hate", "masking", ["x"], True, "review"), ("none", "other", [], False, "no")]


def test_inference_paths(spark, lexicon):
    import random

    o = inference.Options(max_retries=2, first_delay=0, jitter=0, second_model="backup")
    good = json.dumps({"is_coded": "yes", "domain": "hate", "mechanism": "other", "confidence": 1, "reason": "r", "dictionary_hits": []})
    calls = []

    def labeler(q, model, mode, **arguments):
        calls.append((model, mode))
        return "" if model == "primary" else f"text {good} tail"

    a, who = inference.ask_in_turn(labeler, "q", o, random.Random(1))
    assert who == "backup" and a["is_coded"] == "yes" and calls[:4] == [("primary", "structured"), ("primary", "text")] * 2
    with pytest.raises(ValueError, match="invalid"):
        inference.ask_in_turn(lambda *x, **y: good.replace("hate", "nonsense"), "q", o, random.Random(1))
    with pytest.raises(ValueError, match="Raw output: ''"):
        inference.parse_answer(None)
    d = spark.createDataFrame([("x" * n,) for n in (11, 97, 1067, 3)], "text string")
    asked = spark.sparkContext.accumulator(0)
    r = {x["text"]: x for x in inference.label(d, stub_labeler, lexicon, inference.Options(max_retries=1)).collect()}
    many = spark.range(120, numPartitions=1).selectExpr("concat('p', id) AS text")
    assert inference.label(many, stub_labeler, lexicon, inference.Options(per_second=5000), progress=asked).count() == 120 and asked.value == 100
    assert r["x" * 97]["is_coded"] == "error" and r["x" * 97]["needs_review"] and r["x" * 97]["bucket"] is None and r["x" * 97]["hash"] is None
    assert r["x" * 11]["bucket"] == "review" and r["xxx"]["bucket"] == "review"


def test_profiles_leave_out_nulls(spark):
    d = spark.createDataFrame([("s1", "safe"), ("s1", "unsafe"), ("s1", "odd"), (None, "safe"), ("s2", None)], "data string, class string")
    assert [tuple(r) for r in profile.crosstab(d, "data", "class").collect()] == [("s1", 1, 1, 3, 33.3, 33.3, 100.0)]
    assert sorted(tuple(r) for r in profile.crosstab_long(d, "data", "class").collect()) == [("s1", "safe", 1), ("s1", "unsafe", 1)]
    assert {tuple(r) for r in profile.null_counts(d).collect()} == {("data", 1), ("class", 1)}
    assert profile.search(d, "S[12]", "data").count() == 4 and profile.search(d, "S[12]", "data", literal=True).count() == 0
    assert profile.sample(d, 3).count() == 3 and profile.distribution(d.limit(0), "class").count() == 0


def test_search_takes_patterns_of_python(spark):
    import re

    d = spark.createDataFrame([("abab",), ("abba",), ("AB\n",), ("a\\Z",), (None,)], "t string")
    for p in (r"(?P<x_1>ab)(?P=x_1)", r"ab\Z", r"a\\Z", r"\bab", r"b{2}"):
        want = [t for t in ("abab", "abba", "AB\n", "a\\Z") if re.search(p, t, re.I)]
        assert [r["t"] for r in profile.search(d, p, "t").collect()] == want, p
    with pytest.raises(re.error):
        profile.search(d, "(", "t")


def test_explicit_nulls_stay(spark):
    d = spark.createDataFrame([(1, "a", "yes", ["text", "is_coded", "domain"]), (2, "b", "yes", ["text", "is_coded"])], "line int, text string, is_coded string, keys array<string>")
    for c, k in (("domain", "string"), ("mechanism", "string"), ("reasoning", "string"), ("confidence", "double"), ("spans", "array<string>"), ("decoded", "array<string>"), ("needs_review", "boolean")):
        d = d.withColumn(c, F.lit(None).cast(k))
    e = export.extracted_posts(d, keys="keys")
    assert [(r["domain"], r["mechanism"]) for r in e.orderBy("line").collect()] == [(None, ""), ("", "")]
    assert "Domain: None\n" in export.report_blocks(e).where("post_no = 1").first()["block"]


def test_csv_fields(spark, tmp_path):
    rows = [(["a", "b"], [1, 2], True, None, 'q"x, y\nz '), ([], None, None, None, "")]
    d = spark.createDataFrame(rows, "spans array<string>, zz array<int>, needs_review boolean, reasoning string, text string")
    assert [tuple(r) for r in export.csv_projection(d).collect()] == [('q"x, y\nz ', "a, b", "", "true", "[1, 2]"), ("", "", "", "", "")]
    assert export.csv_projection(d).columns == ["text", "spans", "reasoning", "needs_review", "zz"]
    writers.csv_records(d.where("size(spans) > 0"), str(tmp_path / "c"))
    back = files.csv_table(spark, str(tmp_path / "c")).first()
    assert back["spans"] == "a, b" and back["text"].replace("\r\n", "\n") == 'q"x, y\nz '


def test_files(spark, tmp_path):
    p = tmp_path / "posts.txt"
    p.write_bytes("﻿ a \r\n\r\n \nb\xe9".encode() + b"\xff")
    assert [r["text"] for r in files.text_lines(spark, str(p), tolerant=True).collect()] == ["a", "bé�"]
    (tmp_path / "a.json").write_text(json.dumps({"x": [{"meaning": "m"}, {"meaning": "n"}, {}], "y": "no", "z": []}))
    assert [tuple(r) for r in files.lexicon_with_lists(spark, str(tmp_path / "a.json")).collect()] == [(0, "x", "m"), (0, "x", "n")]
    (tmp_path / "b.json").write_text(json.dumps({"x": "m", "y": None, "": "e"}))
    assert [tuple(r) for r in files.lexicon_flat(spark, str(tmp_path / "b.json")).collect()] == [(0, "x", "m"), (1, "y", "")]
    assert files.lexicon_flat(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.jsonl").write_text('{"text": "a", "is_coded": "yes"}\n\n{"text": \n')
    good, bad = files.good_and_bad(files.label_records(spark, str(tmp_path / "r.jsonl")).cache())
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        files.label_records(spark, str(tmp_path / "r.jsonl"), strict=True).collect()
    assert sorted((r["line"], r["value"]) for r in files.numbered_lines(spark, str(tmp_path / "r.jsonl")).collect())[2] == (3, '{"text": ')


def test_arguments_of_model_families():
    o = inference.Options(effort="high")
    assert o.arguments("GPT-5-mini") == {"max_output_tokens": 400, "reasoning": {"effort": "high"}, "text": {"verbosity": "low"}}
    assert o.arguments("other") == {"max_output_tokens": 400, "temperature": 0.2}


def test_a_text_is_asked_about_once_per_copy(spark, lexicon):
    posts = spark.createDataFrame([(i, "same post") for i in range(5)], "id int, text string").coalesce(1)
    todo = dedupe.pending(posts, spark.createDataFrame([], "hash string, is_coded string"), "id")
    assert [(r["id"], r["n_copies"]) for r in todo.collect()] == [(0, 5)]
    got = inference.label(todo, lambda *a, **k: "", lexicon, inference.Options(max_retries=1)).collect()
    assert [r["is_coded"] for r in got] == ["error"] * 5
    n = {"calls": 0}

    def third(q, model, mode, **arguments):
        n["calls"] += 1
        return stub_labeler(q, model, mode, **arguments) if n["calls"] >= 5 else ""

    got = inference.label(todo, third, lexicon, inference.Options(max_retries=1)).collect()
    assert [r["is_coded"] for r in got] == ["error", "error", "yes"]  # two calls an attempt: the fifth one answers


def test_line_numbers_over_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for k in (2, 0, 1):
        (folder / f"{k}.txt").write_text("".join(f"file {k} line {i}\n" for i in range(400)))
    want = [f"file {k} line {i}" for k in range(3) for i in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r["line"], r["value"]) for r in files.numbered_lines(spark, str(folder)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want, 1))


def test_positions_in_a_global_order(spark):
    from postsieve.session import numbered

    d = spark.range(1000).selectExpr("id * 7 % 1009 AS k", "id").repartition(7)
    got = [(r["k"], r["no"]) for r in numbered(d, "k", "no").orderBy("k").collect()]
    assert [n for _, n in got] == list(range(1, 1001)) and got == sorted(got)
    assert numbered(d.limit(0), "k", "no").count() == 0


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from postsieve import session

    far = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match="share"):
        session.shared_folder(far)


def test_run_is_written_and_appended(spark, lexicon, tmp_path):
    posts = spark.createDataFrame([(f"post {'y' * i}",) for i in range(12)], "text string")
    run = inference.label(posts, stub_labeler, lexicon, inference.Options(max_retries=1))
    writers.labelled_run(run, str(tmp_path / "run"), overwrite=True)
    writers.labelled_run(run, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/records")).count() == 24
    assert spark.read.text(str(tmp_path / "run/buckets")).count() == 24


def test_report(spark):
    d = spark.createDataFrame([(7, "t", "yes", None, None, None, None, ["a"], None, None), (8, "u", "no", 1.0, "", "", "", [], [], True)], "line int, text string, is_coded string, confidence double, domain string, mechanism string, reasoning string, spans array<string>, decoded array<string>, needs_review boolean")
    e = export.extracted_posts(d)
    assert [r["block"] for r in export.report_blocks(e).orderBy("post_no").collect()] == ["Found 1 coded posts (yes/unsure):\n", "--- Post 1 ---\nText: t\nLabel: yes (confidence: 0.0)\nDomain: \nMechanism: \nSpans: ['a']\nDecoded: []\nNeeds Review: False\nReasoning: \n"]
    assert json.loads("\n".join(r["value"] for r in export.json_array(e).orderBy("row_no").collect()))[0]["line"] == 7
    assert json.loads("\n".join(r["value"] for r in export.json_array(e.limit(0)).orderBy("row_no").collect())) == []


def test_export_command(spark, tmp_path, capsys):
    from postsieve import export as command

    rows = [{"text": "a", "is_coded": "yes", "confidence": 0.5, "spans": ["x"]}, {"text": "b, c", "is_coded": "no"}, {"text": "d", "is_coded": "unsure", "coded_hits": [{"token": "t"}]}]
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(rows[0]), "", "{broken", *map(json.dumps, rows[1:])]))
    src, out = str(tmp_path / "r.jsonl"), str(tmp_path / "out")
    assert command.main(["posts", src, "-o", out, "-s", f"{out}-report"], spark) == 2 and "2 records" in capsys.readouterr().out
    read = lambda p: "\n".join(x.read_text() for x in sorted((tmp_path / p).glob("part-*")))
    assert [(x["line"], x["text"]) for x in json.loads(read("out"))] == [(1, "a"), (5, "d")]
    assert read("out-report").startswith("Found 2 coded posts (yes/unsure):\n\n--- Post 1 ---\nText: a")
    assert command.main(["csv", src, "-o", f"{out}-csv"], spark) == 3 and files.csv_table(spark, f"{out}-csv").count() == 3
    assert command.main(["coded", src, "-o", f"{out}-coded"], spark) == 1


def test_events_of_a_socket(spark, tmp_path):
    import socket
    import threading

    events = [json.dumps({"commit": {"record": {"$type": collector.POST_TYPE, "text": f"the post of number {i}"}}}) for i in range(40)]
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        for e in events:
            c.sendall(e.encode() + b"\n")
        c.close()

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    reader = collector.SocketReader("127.0.0.1", server.getsockname()[1], str(tmp_path / "spool"), 15, 2.0)
    at, seen, again = reader.initialOffset(), [], []
    for _ in range(6):
        rows, end = reader.read(at)
        seen += [r[0] for r in rows]
        again += [r[0] for r in collector.SocketReader("127.0.0.1", 1, str(tmp_path / "spool"), 15, 0.1).readBetweenOffsets(at, end)]
        at = end
    server.close()
    assert seen == events == again
    q = collector.collect(collector.posts_of(collector.listen(spark, "127.0.0.1", 1, str(tmp_path / "spool"), 100)), str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.text(str(tmp_path / "out")).count() == 40


def test_stream_stops(spark, tmp_path):
    def event(kind, text):
        return json.dumps({"commit": {"record": {"$type": kind, "text": text}}})

    lines = [event(collector.POST_TYPE, f"post\n{i}") for i in range(30)] + [event("like", "x"), "{", json.dumps({"commit": {}}), event(collector.POST_TYPE, "")]
    (tmp_path / "events.jsonl").write_text("\n".join(lines))
    posts = collector.posts_of(collector.replay(spark, str(tmp_path / "events.jsonl"), 10), lambda s: s.map(lambda t: "de" if t.endswith("3") else "en"))
    q = collector.collect(posts, str(tmp_path / "out"), most=12, checkpoint=str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert len(got) == 12 and all(g.startswith("post ") and not g.endswith("3") for g in got)
