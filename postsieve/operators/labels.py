"""Decision rules: labels of rule-matched posts, and the policy for model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .matching import match_posts


def _categories(hits: Column) -> Column:
    return F.array_distinct(F.transform(hits, lambda h: h["category"]))


def _worst(categories: Column, default: str) -> Column:
    known = F.filter(F.array(*map(F.lit, rules.SEVERITY)), lambda c: F.array_contains(categories, c))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


def decide(m: Column, coded_categories: Column) -> Column:
    """struct(label, confidence, reasons) of the categories of both kinds of hits: the first rule that applies decides."""
    a = F.array_remove(coded_categories, "benign")
    out = lambda label, confidence, reason: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.array(reason).alias("reasons"))
    return (
        F.when(F.arrays_overlap(m, F.array(*map(F.lit, rules.MODERATED))), out("moderated", 0.95, F.concat(F.lit("moderation-hit:"), _worst(m, "high"))))
        .when(F.size(a) > 0, out("questionable", 0.80, F.concat(F.lit("coded-harmful:"), _worst(a, "coded"))))
        .when(F.array_contains(m, "harassment"), out("questionable", 0.75, F.lit("moderation-hit:harassment")))
        .when(F.array_contains(m, "spam"), out("questionable", 0.60, F.lit("moderation-hit:spam")))
        .when(F.array_contains(coded_categories, "benign"), out("clean", 0.55, F.lit("coded-benign")))
        .otherwise(out("clean", 0.90, F.lit("no-hits")))
    )


def label_posts(posts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, text, label, confidence, reasons, moderation_hits, coded_hits) of posts (key, text)."""
    d = match_posts(posts.select(key, "text"), key, lexicon)
    # categories are columns of their own, as the rules refer to them many times
    d = d.withColumns({"_m": _categories(F.col("moderation_hits")), "_c": _categories(F.col("coded_hits"))}).withColumn("_d", decide(F.col("_m"), F.col("_c")))
    return d.select(key, "text", "_d.label", "_d.confidence", "_d.reasons", "moderation_hits", "coded_hits")


def answer_policy(answers: DataFrame, review_below: float = rules.REVIEW_BELOW) -> DataFrame:
    """Forced fields of negative answers, the review flag, and the bucket of each answer."""
    no = F.col("is_coded") == "no"
    empty = F.array().cast("array<string>")
    a = answers.withColumns(
        {
            "domain": F.when(no, "none").otherwise(F.col("domain")),
            "mechanism": F.when(no, "other").otherwise(F.col("mechanism")),
            "decoded": F.when(no, empty).otherwise(F.col("decoded")),
            "needs_review": (F.col("is_coded") == "unsure") | (F.col("confidence") < review_below),
        }
    )
    return a.withColumn("bucket", bucket(F.col("is_coded"), F.col("needs_review")))


def bucket(is_coded: Column, needs_review: Column) -> Column:
    return F.when(F.coalesce(needs_review, F.lit(False)), "review").when(is_coded == "yes", "yes").when(is_coded == "no", "no").otherwise("review")


def run_counters(labelled: DataFrame) -> DataFrame:
    """One row of counts of a labelling run (is_coded, bucket): processed, yes, clean, review, errors."""
    error = F.coalesce(F.col("is_coded") == "error", F.lit(False))
    return labelled.agg(
        F.count_if(~error).alias("processed"),
        F.count_if(~error & (F.col("bucket") == "yes")).alias("yes"),
        F.count_if(~error & (F.col("bucket") == "no")).alias("clean"),
        F.count_if(~error & (F.col("bucket") == "review")).alias("review"),
        F.count_if(error).alias("errors"),
    )
