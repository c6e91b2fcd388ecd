"""Screening of posts: empty, address-only, handle-only, repeated, numeric and symbol-only texts are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import WORD, digits_only, has_symbol, share_of, strip
from ..session import where_computed


def _rule(t: Column) -> Column:
    """Name of the rule that drops a stripped text, null if it stays; the first rule that applies decides."""
    address = t.rlike(rules.DOMAIN_ENDINGS) & ~t.contains("http://") & ~t.contains("https://")
    # letters and digits of any script, counted as ASCII first: only texts poor in those need the exact share
    poor = F.char_length(F.regexp_replace(t, r"[^A-Za-z0-9 ]+", "")) <= F.char_length(t) * (1 - rules.MAX_SYMBOLS)
    symbolic = (F.char_length(t) > 2) & poor & (share_of(t, r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]") > rules.MAX_SYMBOLS)
    keep = F.lit(None).cast("string")
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"(?iU)^\s*https?://\S+\s*$"), "address")
        .when(address & (share_of(t, r"[.:/@\-]") > rules.MAX_URL_SIGNS), "broken_address")
        .when(t.rlike(rf"^@[{WORD}]+$"), "handle")
        .when(t.rlike(r"^(.)\1{4,}$"), "repeated")
        .when(digits_only(F.regexp_replace(t, r"[ _\-]", "")), "digits")
        .when(symbolic & ~has_symbol(t), "symbols")
        .when(has_symbol(t), keep)
        .when(F.char_length(t) < rules.LEAST_CHARS, "short")
        .otherwise(keep)
    )


def with_garbage_rule(posts: DataFrame, text: str = "text", name: str = "rule") -> DataFrame:
    """Adds the name of the rule that drops each post, null if it stays. A null text counts as empty.

    The stripped text is a column of its own, else every branch would strip again.
    """
    return posts.withColumn("_t", strip(F.coalesce(F.col(text), F.lit("")))).withColumn(name, _rule(F.col("_t"))).drop("_t")


def screen(posts: DataFrame, text: str = "text") -> DataFrame:
    """Posts that stay."""
    return where_computed(with_garbage_rule(posts, text, "_rule"), F.col("_rule").isNull()).drop("_rule")
