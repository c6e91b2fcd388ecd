"""Removal and reporting of repeated rows, keyed by normalised text or content hash.

Groups are pre-aggregated before they are shuffled: the first row of a group is a
``min_by`` over its ordinal, so a text that fills a third of a table costs one row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, strip


def loose_key(text: Column) -> Column:
    """Lower case without outer white space; null counts as the text 'none'."""
    return F.lower(strip(F.coalesce(text, F.lit("None"))))


def keep_first(rows: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """The first row, by ordinal, of every group of equal keys."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    g = rows.select(key.alias("_key"), F.col(ordinal).alias("_at"), whole.alias("_row")).groupBy("_key").agg(F.min_by("_row", "_at").alias("_row"))
    return g.select("_row.*")


def repeated_rows(rows: DataFrame, key: Column) -> DataFrame:
    """All rows of groups with several members."""
    keyed = rows.withColumns({"_k1": F.xxhash64(key), "_k2": F.xxhash64(F.lit(1), key)})  # 128 bits stand for the key in the shuffle
    several = keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_n")).where("_n > 1").select("_k1", "_k2")
    return keyed.join(several, ["_k1", "_k2"], "left_semi").drop("_k1", "_k2")


def excess_rows(rows: DataFrame, key: Column) -> DataFrame:
    """One row: rows in excess of the first of each group."""
    g = rows.groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"))


def done_hashes(answers: DataFrame, legacy: bool = False) -> DataFrame:
    """Hashes of posts already answered; ``legacy`` finds none, as a reader does that looks for a field never written."""
    ok = F.col("is_coded").isin("yes", "no", "unsure") & F.col("hash").isNotNull() & (F.col("hash") != "")
    return answers.where(F.lit(not legacy) & ok).select("hash").distinct()


def pending(posts: DataFrame, answers: DataFrame, ordinal: str, legacy: bool = False) -> DataFrame:
    """Posts (ordinal, text) still to be labelled: unanswered, the first of each text, with ``n_copies``, its number of copies.

    A labelling run may ask once per copy until one of them is answered.
    """
    hashed = posts.withColumn("hash", content_hash(F.col("text")))
    whole = F.struct(*[F.col(c) for c in hashed.columns])
    first = hashed.groupBy("hash").agg(F.min_by(whole, F.col(ordinal)).alias("_row"), F.count("*").alias("n_copies")).select("_row.*", "n_copies")
    return first.join(done_hashes(answers, legacy), "hash", "left_anti")
