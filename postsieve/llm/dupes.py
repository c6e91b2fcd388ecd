"""Duplicates hidden by formatting differences.

Progressive partition refinement: rows are classed by cheap invariants of the
stripped text (its length and a letter histogram, which no reordering of fields
changes). Only classes with several members go on; there the costlier keys, the
whole canonical text and the order-free form of ``name: value`` records, split
the class into groups of copies.

Two texts are copies if they are equal after lower-casing and dropping white
space and punctuation (category P) wherever they stand. A text that consists
only of three or more ``name: value`` fields separated by ``|`` or ``;`` is
compared without regard to the order of its fields and the separator.

Scale: the classes are found by an aggregation of 8-byte keys. Classes of up to
HOT_ROWS rows are refined by windows inside the partitioning of one shuffle;
larger ones keep their texts where they are, are pre-aggregated to one row per
key, and joined back under AQE's skew handling. Their list is broadcast: beyond
HOT_ROWS * MAX_HOT rows a class counts as hot from rows / MAX_HOT members on, so
there are never more than MAX_HOT of them. Both ways give the same groups.

Defined cases: null and blank texts are no cases; a row without an id is never
reported; texts of punctuation only are
copies of each other; ids are unique per table; repeated (tab, id) rows count
once; extra columns are ignored; an empty table gives an empty result.
``contents`` counts rows and has every content, ``group_sizes`` those that recur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 50_000
MAX_HOT = 100_000
#: White space, dropped characters, the letters of the histogram, and the shape of a field.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
DROPPED = rf"[\p{{P}}{SPACE}]+"
LETTERS = "eaotinr"
FIELD = rf"^[{SPACE}]*+\p{{L}}++[{SPACE}]*+:"


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(f"[^{SPACE}]")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), DROPPED, "")


def invariants(s: Column) -> Column:
    """64-bit class of a stripped text: its length and letter histogram, separators of fields left out."""
    s = F.replace(s, F.lit("|"), F.lit(""))
    n = F.char_length(s)
    return F.xxhash64(n, *[n - F.char_length(F.replace(s, F.lit(c), F.lit(""))) for c in LETTERS])


def is_record(text: Column) -> Column:
    """Does the text consist only of three or more fields? Most texts are told by their first word."""
    parts = F.split(text, r"[|;]")
    return text.rlike(FIELD) & (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(FIELD))


def field_form(text: Column) -> Column:
    """Canonical form of a record of fields, null for any other text."""
    parts = F.transform(F.split(text, r"[|;]"), stripped)
    return F.when(is_record(text), F.array_join(F.array_sort(parts), "\u0001"))


def digest(s: Column) -> Column:
    return F.sha2(s, 256)


def canonical(text: Column) -> Column:
    """What copies have in common (null for null and blank texts)."""
    return F.when(~blank(text), F.coalesce(field_form(text), stripped(text)))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "tab", "id", "class", digest("s").alias("plain"), digest(field_form(F.col("text"))).alias("fields")
    )


def _classed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that take part, with their stripped text and class; the number of rows and the smallest id of each class."""
    rows = rows.select("tab", "id", "text").where(~blank(F.col("text"))).withColumn("s", stripped(F.col("text"))).withColumn("class", invariants(F.col("s")))
    return rows, rows.groupBy("tab", "class").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def _split(rows: DataFrame, classes: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(tab, class, id, key) of the rows of classes of several members, those of up to ``hot_rows`` rows and larger ones."""
    classes = classes.where("n > 1")
    hot = F.broadcast(classes.where(F.col("n") > hot_rows).select("tab", "class"))  # at most MAX_HOT, see hot_from
    few = classes.where(F.col("n") <= hot_rows).select("tab", "class")

    cool = _keyed(rows.join(hot, ["tab", "class"], "left_anti").join(few, ["tab", "class"], "left_semi"))
    by_plain = Window.partitionBy("tab", "class", "plain")
    cool = cool.select("tab", "class", "id", F.coalesce("fields", F.min("fields").over(by_plain), "plain").alias("key"))

    many = _keyed(rows.join(hot, ["tab", "class"], "left_semi"))
    adopt = many.where(F.col("fields").isNotNull()).groupBy("tab", "plain").agg(F.min("fields").alias("adopted"))
    many = many.join(adopt, ["tab", "plain"], "left").select("tab", "class", "id", F.coalesce("fields", "adopted", "plain").alias("key"))
    return cool, many


def hot_from(rows: DataFrame, hot_rows: int | None) -> int:
    """Members from which on a class is hot. The count reads no column (Parquet keeps it in its footers)."""
    return max(HOT_ROWS, rows.count() // MAX_HOT) if hot_rows is None else hot_rows


def copies(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(tab, first_id, copy_id) for rows (tab, id, text): each row that is a copy, with the smallest id of its group."""
    hot_rows = hot_from(rows, hot_rows)
    cool, many = _split(*_classed(rows), hot_rows)
    cool = cool.select("tab", F.min("id").over(Window.partitionBy("tab", "class", "key")).alias("first_id"), F.col("id").alias("copy_id"))
    groups = many.groupBy("tab", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    many = many.join(groups, ["tab", "key"]).select("tab", "first_id", F.col("id").alias("copy_id"))
    return cool.unionByName(many).where("copy_id <> first_id")


def contents(rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(tab, first_id, n_rows) for rows (tab, id, text): one record per content, those that occur once included."""
    hot_rows = hot_from(rows, hot_rows)
    rows, classes = _classed(rows.where("id IS NOT NULL"))
    once = classes.where("n = 1").select("tab", F.col("least").alias("first_id"), F.col("n").alias("n_rows"))
    cool, many = _split(rows, classes, hot_rows)
    # partial counts and their merge: a hot key makes one row per task
    groups = [g.groupBy("tab", "class", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("n_rows")).select("tab", "first_id", "n_rows") for g in (cool, many)]
    return once.unionByName(groups[0]).unionByName(groups[1])


def group_sizes(found: DataFrame) -> DataFrame:
    """(tab, first_id, n_rows): one record per content that recurs, with its number of rows."""
    return found.groupBy("tab", "first_id").agg((F.count("*") + 1).alias("n_rows"))
