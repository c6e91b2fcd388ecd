"""Projections of label records for exports: CSV fields, extracted posts, text reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..session import numbered


@F.pandas_udf(T.StringType())
def _spaced_json(s: pd.Series) -> pd.Series:
    """Compact JSON with a space behind separators."""
    return s.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False), na_action="ignore")


def as_field(column: Column, kind: T.DataType) -> Column:
    """Text of a value in a CSV field: lists of strings joined, other lists as JSON, booleans in lower case, null empty."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(column, ", ") if isinstance(kind.elementType, T.StringType) else _spaced_json(F.to_json(column))
    elif isinstance(kind, (T.MapType, T.StructType)):
        text = _spaced_json(F.to_json(column))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def export_columns(columns: list[str]) -> list[str]:
    """Known columns first, in their fixed order, then the others by name."""
    return [c for c in rules.EXPORT_COLUMNS if c in columns] + sorted(set(columns) - set(rules.EXPORT_COLUMNS))


def csv_projection(records: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in records.schema}
    return records.select(*[as_field(F.col(c), kinds[c]).alias(c) for c in export_columns(records.columns)])


def extracted_posts(records: DataFrame, order: str = "line", keys: str | None = None) -> DataFrame:
    """Posts answered yes or unsure, with defaults for missing fields and their number.

    ``keys`` names a column with the keys of the record as written: a field that is
    there and null then stays null; without it a null counts as missing.
    """
    empty = F.array().cast("array<string>")
    defaults = {"text": F.lit(""), "confidence": F.lit(0.0), "domain": F.lit(""), "mechanism": F.lit(""), "reasoning": F.lit(""), "spans": empty, "decoded": empty, "needs_review": F.lit(False)}

    def filled(c: str) -> Column:
        whole = F.coalesce(F.col(c), defaults[c])
        return (whole if keys is None else F.when(F.array_contains(keys, c), F.col(c)).otherwise(whole)).alias(c)

    d = records.where(F.col("is_coded").isin("yes", "unsure"))
    return d.select(order, filled("text"), "is_coded", *[filled(c) for c in defaults if c != "text"])


def report_blocks(extracted: DataFrame, order: str = "line") -> DataFrame:
    """(post_no, block): the printable block of each extracted post, numbered from one; number 0 is the head with their count."""
    shown = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("None"))
    quoted = lambda c: shown(F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
    line = "--- Post %d ---\nText: %s\nLabel: %s (confidence: %s)\nDomain: %s\nMechanism: %s\nSpans: %s\nDecoded: %s\nNeeds Review: %s\nReasoning: %s\n"
    yes = F.when(F.col("needs_review").isNull(), "None").when(F.col("needs_review"), "True").otherwise("False")
    d = numbered(extracted, order, "post_no")
    block = F.format_string(line, "post_no", shown("text"), "is_coded", shown(F.col("confidence").cast("string")), shown("domain"), shown("mechanism"), quoted("spans"), quoted("decoded"), yes, shown("reasoning"))
    head = extracted.agg(F.count("*").alias("n")).select(F.lit(0).cast("bigint").alias("post_no"), F.format_string("Found %d coded posts (yes/unsure):\n", "n").alias("block"))
    return head.unionByName(d.select("post_no", block.alias("block")))


def json_array(extracted: DataFrame, order: str = "line") -> DataFrame:
    """(row_no, value): the lines of one JSON array of all extracted posts; in the order of row_no they are one document."""
    d = numbered(extracted, order, "row_no")
    n = extracted.agg(F.count("*").alias("n"))
    element = F.to_json(F.struct(*extracted.columns), {"pretty": "true", "ignoreNullFields": "false"})
    last = F.when(F.col("row_no") == F.col("n"), "").otherwise(",")
    body = d.join(F.broadcast(n), F.lit(True)).select("row_no", F.concat(F.regexp_replace(element, r"(?m)^", "  "), last).alias("value"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("row_no"), F.lit("[").alias("value")), F.struct((F.col("n") + 1).alias("row_no"), F.lit("]").alias("value")))).alias("e")).select("e.*")
    return body.unionByName(ends)
