"""Profiles of labelled tables: null counts, distributions, crosstabs, search and samples."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("safe", "unsafe")
_PERCENT = 1  # decimals


def null_counts(rows: DataFrame) -> DataFrame:
    """(column_name, nulls), in one pass over all columns."""
    one = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    return one.unpivot([], list(rows.columns), "column_name", "nulls")


def shape(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(rows.columns)))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, percent) without nulls; percent to one decimal, half to even."""
    n = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # the window runs over one row per value, not over the rows
    return n.withColumn("percent", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), _PERCENT))


def crosstab(rows: DataFrame, by: str, column: str, values: tuple[str, ...] = CLASSES) -> DataFrame:
    """Counts per value, their total over all values, and row percents; rows with a null in either column are left out."""
    has = rows.where(F.col(by).isNotNull() & F.col(column).isNotNull())
    n = has.groupBy(by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))
    return n.withColumns({f"{v}_pct": F.bround(F.col(v) * 100.0 / F.col("total"), _PERCENT) for v in values}).withColumn("total_pct", F.lit(100.0))


def crosstab_long(rows: DataFrame, by: str, column: str, values: tuple[str, ...] = CLASSES) -> DataFrame:
    """(by, column, n) with a row for every combination."""
    return crosstab(rows, by, column, values).unpivot([by], list(values), column, "n")


def pivot_counts(rows: DataFrame, by: str, column: str, values: tuple[str, ...] = CLASSES) -> DataFrame:
    has = rows.where(F.col(by).isNotNull() & F.col(column).isNotNull())
    return has.groupBy(by).pivot(column, list(values)).count().na.fill(0, list(values))


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(version, column, n) of two versions of a table."""
    both = [d.select(F.lit(v).alias("version"), column) for v, d in (("Before", before), ("After", after))]
    return reduce(DataFrame.unionByName, both).where(F.col(column).isNotNull()).groupBy("version", column).agg(F.count("*").alias("n"))


def java_pattern(pattern: str) -> str:
    """A pattern of Python's syntax as Java has it: named groups and their references, the end of the text. Raises re.error as Python does."""
    re.compile(pattern)
    p = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'u')}>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', 'u')}>", p)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", p)


def search(rows: DataFrame, query: str, column: str, literal: bool = False) -> DataFrame:
    """Rows whose column holds the pattern (Python's syntax) or the literal text, ignoring case; nulls never do."""
    hit = F.contains(F.lower(column), F.lower(F.lit(query))) if literal else F.col(column).rlike(f"(?iU){java_pattern(query)}")
    return rows.where(F.coalesce(hit, F.lit(False)))


def top(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows without replacement: the feature is the sample."""
    return rows.orderBy(F.rand(seed)).limit(n)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def tagged_union(parts: list[tuple[DataFrame, dict[str, str], dict[str, str]]]) -> DataFrame:
    """Union of (table, {source column: name}, {constant column: value}) projections, missing columns null."""
    made = [d.select(*[F.col(c).alias(n) for c, n in names.items()], *[F.lit(v).alias(n) for n, v in tags.items()]) for d, names, tags in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def suffixed(rows: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumnsRenamed({c: c + suffix for c in rows.columns if c not in keep})
