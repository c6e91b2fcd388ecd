from __future__ import annotations

import json

import pytest

from postsieve.operators import drift

SCHEMA = "record_id bigint, run_id bigint, file_seq int, file_name string, line_no int, raw string, fields string"


def lines(spark, files):
    """files: {(run, seq): [object or raw string]}; the extra column clashes with a name used inside."""
    rows, n = [], 0
    for (run, seq), objs in files.items():
        for i, o in enumerate(objs):
            n += 1
            rows.append((n, run, seq, "f", i, o if isinstance(o, str) or o is None else json.dumps(o), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r)[1:] for r in drift.drift_changes(lines(spark, files)).collect())


def posts(n, **extra):
    return [{"text": f"t{i}", **{k: (v(i) if callable(v) else v) for k, v in extra.items()}} for i in range(n)]


def test_renamed_needs_nine_tenths(spark):
    old = posts(10, model=lambda i: f"m{i}")
    nine = posts(10, model_used=lambda i: "z" if i == 0 else f"m{i}")
    eight = posts(10, model_used=lambda i: "z" if i < 2 else f"m{i}")
    assert changes(spark, {(1, 1): old, (1, 2): nine}) == [(2, "renamed", "model", "model_used")]
    assert changes(spark, {(1, 1): old, (1, 2): eight}) == [(2, "added", "model_used", "model_used"), (2, "removed", "model", "model")]


def test_no_shared_posts_is_no_rename(spark):
    later = [{"text": f"u{i}", "b": 1} for i in range(3)]
    assert changes(spark, {(1, 1): posts(3, a=1), (1, 2): later}) == [(2, "added", "b", "b"), (2, "removed", "a", "a")]


def test_retyped_by_majority_and_nulls(spark):
    a = posts(3, c=lambda i: [1, 2.5, None][i], d=None)
    b = posts(3, c=lambda i: ["1", "2", 3][i], d="x")
    assert changes(spark, {(1, 1): a, (1, 2): b}) == [(2, "retyped", "c", "c")]


def test_rare_fields_do_not_belong(spark):
    a = posts(11)
    a[0]["debug"] = 1
    b = posts(10)
    b[0]["debug"] = 1
    assert changes(spark, {(1, 1): a, (1, 2): posts(11)}) == []
    assert changes(spark, {(1, 1): posts(10), (1, 2): b}) == [(2, "added", "debug", "debug")]


def test_bad_lines_and_files_do_not_count(spark):
    bad = [None, "", "{", '{"text": "a", ', "[1]", "7"]
    assert changes(spark, {(1, 1): [*posts(2, a=1), *bad], (1, 2): bad, (1, 3): posts(2, a=1)}) == []


def test_runs_are_separate_and_numbers_compare_by_value(spark):
    assert changes(spark, {(1, 1): posts(2, a=1), (2, 2): posts(2, b=1)}) == []
    assert changes(spark, {(1, 1): posts(2, a=1), (1, 2): posts(2, b=1.0)}) == [(2, "renamed", "a", "b")]


def test_repeated_texts_count_as_pairs(spark):
    a = [{"text": "t", "a": 1}] * 50
    b = [{"text": "t", "b": 1}] * 40
    assert changes(spark, {(1, 1): a, (1, 2): b}) == [(2, "renamed", "a", "b")]


def test_lines_without_a_run_take_no_part(spark):
    d = lines(spark, {(1, 1): posts(3, a=1), (1, 2): posts(3, a=1)})
    lost = lines(spark, {(1, 1): posts(3, zz=1)}).selectExpr("record_id", "CAST(NULL AS bigint) AS run_id", "file_seq", "file_name", "line_no", "raw", "fields")
    assert drift.drift_changes(d.unionByName(lost)).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert drift.drift_changes(none).count() == 0
    assert drift.unify(none).count() == 0


def test_unify_follows_renames_and_converts(spark):
    a = posts(4, model=lambda i: f"m{i}", confidence=0.5, spans=lambda i: ["a"])
    b = posts(4, model_used=lambda i: f"m{i}", confidence="0.25", spans="a", needs_review="true")
    d = drift.unify(lines(spark, {(1, 1): a, (1, 2): b})).orderBy("file_seq", "line_no").collect()
    assert [r["model_used"] for r in d] == ["m0", "m1", "m2", "m3"] * 2
    assert [r["confidence"] for r in d] == [0.5] * 4 + [0.25] * 4
    assert all(r["spans"] == ["a"] for r in d)
    assert d[4]["needs_review"] is True and {b["column"]: b["string"] for b in d[4]["branches"]} == {"confidence": "0.25", "spans": "a", "needs_review": "true"}


def test_numbers_are_exact(spark):
    a, b = posts(4, uid=lambda i: 9007199254740992 + 2 * i), posts(4, oid=lambda i: 9007199254740993 + 2 * i)
    assert changes(spark, {(1, 1): a, (1, 2): b}) == [(2, "added", "oid", "oid"), (2, "removed", "uid", "uid")]
    assert changes(spark, {(1, 1): posts(3, a=0.1), (1, 2): ['{"text": "t0", "b": 0.10}', '{"text": "t1", "b": 0.100}', '{"text": "t2", "b": 0.1}']}) == [(2, "renamed", "a", "b")]
    u = drift.unify(lines(spark, {(1, 1): posts(1, uid=9007199254740993, hash=9007199254740993)})).first()
    assert u["rest"]["uid"]["val"] == "9007199254740993" and u["hash"] == "9007199254740993" and int(u["branches"][0]["number"]) == 9007199254740993


def test_branches_are_typed(spark):
    u = drift.unify(lines(spark, {(1, 1): posts(1, hash=["a", "b"], domain={"k": 1}, mechanism=True, spans=2.50)})).first()
    b = {x["column"]: x for x in u["branches"]}
    assert b["hash"]["array"] == ["a", "b"] and b["mechanism"]["boolean"] is True and float(b["spans"]["number"]) == 2.5 and b["domain"]["object"] == '{"k":1}'
    assert (u["hash"], u["mechanism"], u["spans"]) == ("a, b", "true", ["2.5"])


def test_renames_of_a_run_stay_in_it(spark):
    m = lambda i: f"m{i}"
    renamed = {(1, 1): posts(4, reason=m), (1, 2): posts(4, reasoning=m)}
    both = {(2, 1): posts(4, reason=m, reasoning=lambda i: f"z{i}"), (2, 2): posts(4, reason=m, reasoning=lambda i: f"z{i}")}
    d = {(r["run_id"], r["file_seq"], r["line_no"]): r for r in drift.unify(lines(spark, {**renamed, **both})).collect()}
    assert d[1, 1, 0]["reasoning"] == d[1, 2, 0]["reasoning"] == "m0" and not d[1, 1, 0]["rest"]
    assert d[2, 1, 0]["reasoning"] == "z0" and d[2, 1, 0]["rest"]["reason"]["val"] == "m0"
    # without any change there is no evidence; with it in another run there is
    alone = {(3, 1): posts(4, reason=m)}
    assert drift.unify(lines(spark, alone)).first()["reasoning"] is None
    assert [r["reasoning"] for r in drift.unify(lines(spark, {**renamed, **alone})).where("run_id = 3").orderBy("line_no").collect()] == ["m0", "m1", "m2", "m3"]


def test_chains_of_renames(spark):
    m = lambda i: f"m{i}"
    d = drift.unify(lines(spark, {(1, 1): posts(4, a=m), (1, 2): posts(4, b=m), (1, 3): posts(4, model_used=m), (1, 4): posts(4, c=m)}))
    assert [r["model_used"] for r in d.orderBy("file_seq", "line_no").collect()] == ["m0", "m1", "m2", "m3"] * 4


@pytest.mark.parametrize("n", [1, 10])
def test_long_values(spark, n):
    big = posts(n, a="x" * 200_000)
    other = [{"text": o["text"], "b": o["a"]} for o in big]
    assert changes(spark, {(1, 1): big, (1, 2): other}) == [(2, "renamed", "a", "b")]
