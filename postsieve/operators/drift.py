"""Schemas that drift between the files of a run.

Tagged-union inference. Every parsable line is read as a map from field to a
tagged value (tag, text); per file the parallel schemas of its lines are fused
into one schema that keeps the count of every alternative type of a field.
Comparing the fused schema of a file with that of the file before gives the
changes; a field that vanished and a field that appeared are one renamed field
when their values agree on the posts both files hold. ``unify`` follows the
renames of each run from file to file and reads all lines into one table:
conflicting types are split into typed branches, and the canonical column converts
each branch.

Numbers are kept as written, to every digit; 1 and 1.0 are equal.

Defined cases: lines without a run or a file number take no part;
null, empty, cut off or non-object lines are unparsable and do
not count; a file without a parsable line is no file of the run; a field whose
values are all null has no type and is never retyped; equal counts of two
types are decided for the alphabetically first; extra columns of the input
are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, where_computed

PRESENCE_SHARE = 10  # a field belongs to a file if count * PRESENCE_SHARE >= lines
RENAME_AGREE = (9, 10)  # equal values on at least 9 of 10 matched posts


def _tag(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _number(text: Column) -> Column:
    """A JSON number without trailing zeros behind the point; one with an exponent as it is."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike("[eE]"), text).when(plain == "-0", "0").otherwise(plain)


def _text_of(value: Column, tag: Column) -> Column:
    # numbers compare by value, everything else by its JSON
    return F.when(tag == "number", _number(value.cast("string"))).when(tag == "string", value.cast("string")).otherwise(F.to_json(value))


def _parsed(lines: DataFrame) -> DataFrame:
    # null for a line that is no JSON object
    m = F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>")
    return lines.select("run_id", "file_seq", "line_no", "record_id", m.alias("m"))


def _placed(d: DataFrame, column: str) -> DataFrame:
    return where_computed(d, F.col(column).isNotNull() & F.col("run_id").isNotNull() & F.col("file_seq").isNotNull())


def tagged_lines(lines: DataFrame) -> DataFrame:
    """(run_id, file_seq, line_no, record_id, text, fields map<string, struct<tag, val>>) of parsable lines."""
    def tagged(_: Column, x: Column) -> Column:
        x = F.coalesce(x, F.parse_json(F.lit("null")))
        tag = _tag(x)
        return F.struct(tag.alias("tag"), _text_of(x, tag).alias("val"))

    d = _parsed(lines).select("run_id", "file_seq", "line_no", "record_id", F.transform_values("m", tagged).alias("fields"))
    text = F.element_at(F.col("fields"), "text")
    return _placed(d.withColumn("text", F.when(text["tag"] == "string", text["val"])), "fields")


def typed_lines(lines: DataFrame) -> DataFrame:
    """(run_id, file_seq, types map<string, string>) of parsable lines: what the schemas need, no value is written out."""
    d = _parsed(lines).select("run_id", "file_seq", F.transform_values("m", lambda _, x: _tag(F.coalesce(x, F.parse_json(F.lit("null"))))).alias("types"))
    return _placed(d, "types")


def type_alternatives(typed: DataFrame) -> DataFrame:
    """Fused schema per file: (run_id, file_seq, field, tag, n, n_lines) with every alternative type."""
    # a pseudo-field that every line has counts the lines in the same pass
    entries = F.concat(F.map_entries("types"), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("line").alias("value"))))
    seen = (
        typed.select("run_id", "file_seq", F.explode(entries).alias("e"))
        .groupBy("run_id", "file_seq", F.col("e.key").alias("field"), F.col("e.value").alias("tag"))
        .agg(F.count("*").alias("n"))
    )
    # over one row per file, field and type
    n_lines = F.max(F.when(F.col("tag") == "line", F.col("n"))).over(Window.partitionBy("run_id", "file_seq"))
    return seen.withColumn("n_lines", n_lines).where("field IS NOT NULL")


def file_schemas(alternatives: DataFrame) -> DataFrame:
    """(run_id, file_seq, schema map<field, type>, prev_seq, prev map<field, type>) of each file of a run."""
    rank = F.struct((-F.col("n")).alias("neg"), F.col("tag"))
    per_field = (
        alternatives.groupBy("run_id", "file_seq", "field", "n_lines")
        .agg(F.sum("n").alias("present"), F.min(F.when(F.col("tag") != "null", rank)).alias("best"))
        .where(F.col("present") * PRESENCE_SHARE >= F.col("n_lines"))
    )
    # a file has at most PRESENCE_SHARE times the mean keys of a line as fields: the list is bounded
    per_file = per_field.groupBy("run_id", "file_seq").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("best.tag", F.lit("null"))))).alias("schema")
    )
    w = Window.partitionBy("run_id").orderBy("file_seq")
    return per_file.withColumns({"prev_seq": F.lag("file_seq").over(w), "prev": F.lag("schema").over(w)})


def _steps(schemas: DataFrame) -> DataFrame:
    """One row per file that has a file before it: gone, new and retyped fields."""
    cur, prev = F.map_keys("schema"), F.map_keys("prev")

    def retyped(f: Column) -> Column:
        a, b = F.element_at(F.col("prev"), f), F.element_at(F.col("schema"), f)
        return (a != b) & (a != "null") & (b != "null")

    return schemas.where(F.col("prev_seq").isNotNull()).select(
        "run_id",
        "file_seq",
        "prev_seq",
        F.array_except(prev, cur).alias("gone"),
        F.array_except(cur, prev).alias("new"),
        F.filter(F.array_intersect(prev, cur), retyped).alias("retyped"),
    )


def rename_evidence(tagged: DataFrame, steps: DataFrame) -> DataFrame:
    """(run_id, file_seq, old, new, agree, both): value agreement of each vanished and each appeared field.

    Only aggregations: posts are counted by (text, value) before they meet, so a
    text that fills a file never multiplies rows.
    """
    open_ = steps.where((F.size("gone") > 0) & (F.size("new") > 0))

    roles = F.explode(F.array(F.struct(F.col("prev_seq").alias("at"), F.lit(True).alias("before")), F.struct(F.col("file_seq").alias("at"), F.lit(False).alias("before"))))
    s = open_.select("run_id", F.col("file_seq").alias("step"), "gone", F.col("new").alias("fresh"), roles.alias("r")).select("run_id", "step", "gone", "fresh", "r.at", "r.before")
    t = tagged.where(F.col("text").isNotNull()).select("run_id", F.col("file_seq").alias("at"), "text", "fields")
    j = t.join(s, ["run_id", "at"])
    j = j.select("run_id", "step", "text", "fields", "before", "fresh", F.explode("gone").alias("old"))
    j = j.select("run_id", "step", "text", "fields", "before", "old", F.explode("fresh").alias("new"))
    both = j.withColumn("x", F.element_at("fields", F.when(F.col("before"), F.col("old")).otherwise(F.col("new"))))
    both = both.where("x IS NOT NULL").withColumns({"a": F.when(F.col("before"), 1).otherwise(0), "b": F.when(F.col("before"), 0).otherwise(1)})
    by_value = both.groupBy("run_id", "step", "old", "new", "text", "x.tag", "x.val").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by_text = by_value.groupBy("run_id", "step", "old", "new", "text").agg(
        F.sum(F.col("a") * F.col("b")).alias("agree"), (F.sum("a") * F.sum("b")).alias("both")
    )
    return (
        by_text.groupBy("run_id", F.col("step").alias("file_seq"), "old", "new")
        .agg(F.sum("agree").alias("agree"), F.sum("both").alias("both"))
        .where(F.col("both") > 0)
    )


def _renames(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """(run_id, file_seq, pairs array<struct<old, now>>): the renamed fields of each file."""
    num, den = RENAME_AGREE
    found = rename_evidence(tagged_lines(lines), steps).where(F.col("agree") * den >= F.col("both") * num)
    return found.groupBy("run_id", "file_seq").agg(F.collect_list(F.struct("old", F.col("new").alias("now"))).alias("pairs"))


def drift_changes(lines: DataFrame) -> DataFrame:
    """(run_id, file_seq, change, field, new_field): every change from the file before of the same run."""
    steps = _steps(file_schemas(type_alternatives(typed_lines(lines))))
    j = steps.join(_renames(lines, steps), ["run_id", "file_seq"], "left")
    pairs = F.coalesce("pairs", F.array().cast("array<struct<old:string,now:string>>"))

    def same(change: str) -> object:
        return lambda f: F.struct(F.lit(change).alias("change"), f.alias("field"), f.alias("new_field"))

    found = F.concat(
        F.transform(pairs, lambda p: F.struct(F.lit("renamed").alias("change"), p["old"].alias("field"), p["now"].alias("new_field"))),
        F.transform(F.array_except("gone", F.transform(pairs, lambda p: p["old"])), same("removed")),
        F.transform(F.array_except("new", F.transform(pairs, lambda p: p["now"])), same("added")),
        F.transform(F.col("retyped"), same("retyped")),
    )
    return j.select("run_id", "file_seq", F.inline(found))


# ---- one consistent table -------------------------------------------------

#: The columns of a label record and their types.
TARGET = {
    "hash": "string",
    "is_coded": "string",
    "domain": "string",
    "mechanism": "string",
    "confidence": "double",
    "spans": "array<string>",
    "decoded": "array<string>",
    "reasoning": "string",
    "needs_review": "boolean",
    "model_used": "string",
}
MAX_NAMES = 100_000  # distinct (old, new) field names; beyond it the input is no set of label files


def lineages(lines: DataFrame) -> DataFrame:
    """(run_id, file_seq, field, lineage): what each field of a file was called where it first appeared in its run.

    One row per file travels, in the order of its run; a run is read as a stream whose
    state is the fields of one file.
    """
    schemas = cut_lineage(file_schemas(type_alternatives(typed_lines(lines))))  # one row per file
    files = schemas.join(_renames(lines, _steps(schemas)), ["run_id", "file_seq"], "left")
    pairs = F.coalesce("pairs", F.array().cast("array<struct<old:string,now:string>>"))
    files = files.select("run_id", "file_seq", F.map_keys("schema").alias("fields"), F.transform(pairs, lambda p: p["old"]).alias("olds"), F.transform(pairs, lambda p: p["now"]).alias("news"))
    kinds = dict(files.dtypes)

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, {}
        for b in batches:
            out = []
            for r, seq, fields, olds, news in zip(b["run_id"], b["file_seq"], b["fields"], b["olds"], b["news"]):
                if r != run:
                    run, state = r, {}
                now = {}
                for f in fields:
                    known = [state[f]] if f in state else []
                    known += [state[o] for o, n in zip(olds, news) if n == f and o in state]
                    now[f] = min(known, default=f"{seq:09d}:{f}")
                state = now
                out += [(r, seq, f, x) for f, x in now.items()]
            yield pd.DataFrame(out, columns=["run_id", "file_seq", "field", "lineage"])

    ordered = files.repartition("run_id").sortWithinPartitions("run_id", "file_seq")
    return ordered.mapInPandas(op, f"run_id {kinds['run_id']}, file_seq {kinds['file_seq']}, field string, lineage string")


def column_names(lines: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """(run_id, file_seq, names map<column, field>): under which name a file holds a column of ``target``, where not its own.

    A field is the column whose name its lineage bears in some file of the run. A
    lineage without such a name is the column that its names were most often renamed
    to or from in other runs, if any. A file that has the column's own name keeps to
    it; of several fields for a column the first by name counts.
    """
    part = cut_lineage(lineages(lines))
    inside = F.col("field").isin(*target)
    # neighbours in the chain of a lineage vote for each other
    chain = part.groupBy("run_id", "lineage").agg(F.collect_set("field").alias("names"))
    votes = chain.select(F.explode(F.filter("names", lambda x: ~x.isin(*target))).alias("name"), F.explode(F.filter("names", lambda x: x.isin(*target))).alias("column"))
    votes = votes.groupBy("name", "column").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("column", F.struct("n", "column")).alias("voted"), F.max("n").alias("n"))
    n = votes.limit(MAX_NAMES + 1).count()
    if n > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} renamed names")
    best = part.join(F.broadcast(votes.withColumnRenamed("name", "field")), "field", "left").groupBy("run_id", "lineage")
    best = best.agg(F.coalesce(F.min(F.when(inside, F.col("field"))), F.max(F.struct("n", "voted"))["voted"]).alias("column")).where("column IS NOT NULL")
    named = part.where(~inside).join(best, ["run_id", "lineage"]).groupBy("run_id", "file_seq", "column").agg(F.min("field").alias("field"))
    return named.groupBy("run_id", "file_seq").agg(F.map_from_entries(F.collect_list(F.struct("column", "field"))).alias("names"))


def _canonical(x: Column, kind: str) -> Column:
    tag, val = x["tag"], x["val"]
    as_list = F.when(tag == "array", F.from_json(val, "array<string>")).when(tag != "null", F.array(val))
    if kind == "array<string>":
        return as_list
    if kind == "string":
        return F.when(tag == "array", F.array_join(as_list, ", ")).when(tag != "null", val)
    return F.when(tag != "null", val.try_cast(kind))


def _branch(name: str, x: Column) -> Column:
    """A value of another type than its column's, in the branch of its own type."""
    tag, val = x["tag"], x["val"]
    own = {"string": val, "number": val.try_cast("decimal(38,12)"), "boolean": val.try_cast("boolean"), "array": F.from_json(val, "array<string>"), "object": val}
    return F.struct(F.lit(name).alias("column"), tag.alias("tag"), *[F.when(tag == k, v).alias(k) for k, v in own.items()], val.alias("written"))


def unify(lines: DataFrame, target: dict[str, str] = TARGET) -> DataFrame:
    """All parsable lines in one table with the columns of ``target``.

    Values of another type than the column's are converted (a list joined, a number
    parsed, an object kept as JSON); ``branches`` keeps them in the branch of their
    type, and as written, ``rest`` the fields outside the table.
    """
    d = tagged_lines(lines).join(column_names(lines, target), ["run_id", "file_seq"], "left")
    # the file's own name first, else the name it has for the column; looked up once per line, as many expressions read them
    look = lambda c: F.coalesce(F.element_at("fields", c), F.element_at("fields", F.element_at("names", c)))
    d = d.withColumn("_at", F.transform(F.array(*map(F.lit, target)), look))
    value = {c: F.when(F.get("_at", F.lit(i))["tag"] != "null", F.get("_at", F.lit(i))) for i, c in enumerate(target)}
    own = {"string": "string", "double": "number", "boolean": "boolean", "array<string>": "array"}
    odd = F.array_compact(F.array(*[F.when(value[c]["tag"] != own[k], _branch(c, value[c])) for c, k in target.items()]))
    # a renamed field counts as used where the file lacks the column's own name
    aliases = F.coalesce(F.map_values(F.map_filter("names", lambda c, _: ~F.array_contains(F.map_keys("fields"), c))), F.array().cast("array<string>"))
    used = F.concat(aliases, F.array(*map(F.lit, target), F.lit("text")))
    return d.select(
        "record_id",
        "run_id",
        "file_seq",
        "line_no",
        "text",
        *[_canonical(value[c], kind).alias(c) for c, kind in target.items()],
        odd.alias("branches"),
        F.map_filter("fields", lambda k, _: ~F.array_contains(used, k)).alias("rest"),
    )
