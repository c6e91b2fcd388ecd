"""Mixing sources to target weights.

Weighted fair queueing: the documents of a source are shuffled by a hash and get
a virtual finish time, the running token total of their source divided by its
weight. Taking documents in order of finish time serves every source in proportion
to its weight at any moment; the global order is cut where the running token total
reaches the budget. A further use of a source starts after all its documents were
used once more, up to its cap.

Shares: targets of sources without documents (or without a usable share or cap)
cannot be met; the others are scaled to sum to one. The default budget is the
largest at which no source runs out, so that every share is met up to one document.

Scale: running totals are two-level. A source is cut into buckets of its shuffle
of about BUCKET_ROWS documents, whose totals give each bucket its offset; inside
a bucket a window sums up. The global order is cut the same way into equal spans
of virtual time, so that no task sees a whole source or the whole mixture. Only
one row per source, and per bucket, meets the targets.

Defined cases: documents without tokens (null and empty texts) are never used;
null sources and sources without a target take no part; a null cap is 1, a cap
under 1 and a null or non-positive share leave the source out; repeated source
rows in the targets: the first by share and cap counts; equal finish times are
ordered by source, document and use; extra columns are ignored; empty tables
give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import encode

BUCKET_ROWS = 50_000
MAX_SOURCES = 100_000


def plan_sources(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[list[dict], float]:
    """Per target source its weight, tokens, cap and uses; and the budget. One row per source reaches the driver."""
    one = Window.partitionBy("source").orderBy(F.desc_nulls_last("target_share"), F.asc_nulls_last("max_repeats"))
    t = targets.where("source IS NOT NULL").withColumn("_n", F.row_number().over(one)).where("_n = 1").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    totals = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in t.join(totals, "source", "left").na.fill(0, ["docs", "tokens"]).orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    for r in rows:
        r["usable"] = bool(r["tokens"] and r["cap"] >= 1 and (r["target_share"] or 0) > 0)
    whole = sum(r["target_share"] for r in rows if r["usable"])
    for r in rows:
        r["weight"] = r["target_share"] / whole if r["usable"] else 0.0
    most = min((r["tokens"] * r["cap"] / r["weight"] for r in rows if r["usable"]), default=0.0)
    total = float(most if budget is None else budget)
    for r in rows:
        r["uses"] = min(r["cap"], int(total * r["weight"] // r["tokens"]) + 1) if r["usable"] else 0
    return rows, total


def _running(df: DataFrame, parts: list[str], order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the running total of ``value`` over parts[:-1], ordered by the bucket parts[-1], then by ``order``."""
    *outer, bucket = parts
    sums = df.groupBy(*parts).agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*outer).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*parts, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rank"))
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = df.join(offsets, parts)
    return j.withColumns({name: F.col("_before") + F.sum(value).over(inside), f"{name}_rank": F.col("_rank") + F.row_number().over(Window.partitionBy(*parts).orderBy(*order))}).drop("_before", "_rank")


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """((position, doc_id, source, use, n_tokens, finish), plan) of the mixture of sized documents (doc_id, source, n_tokens)."""
    spark = sized.sparkSession
    sized = sized.where("n_tokens > 0 AND source IS NOT NULL")
    plan, total = plan_sources(sized, targets, budget)
    used = [(r["source"], float(r["weight"]), int(r["tokens"]), int(r["uses"])) for r in plan if r["uses"] > 0]
    sources = F.broadcast(spark.createDataFrame(used, "source string, weight double, tokens bigint, uses int"))  # at most MAX_SOURCES rows
    n_docs = sum(r["docs"] for r in plan)
    n_buckets = max(8, n_docs // BUCKET_ROWS)

    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    d = sized.join(sources, "source").withColumns({"_h": h, "_bucket": F.pmod(F.shiftrightunsigned(h, 20), F.lit(n_buckets))})
    d = _running(d, ["source", "_bucket"], ["_h", "doc_id"], "n_tokens", "_cum")
    d = d.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    d = d.withColumn("finish", (F.col("_cum") + (F.col("use") - 1) * F.col("tokens")) / F.col("weight")).where(F.col("finish") <= total * (1 + 1e-12))
    spans = max(8, int(sum(r["docs"] * r["uses"] for r in plan)) // BUCKET_ROWS)
    d = d.select("doc_id", "source", "use", "n_tokens", "finish", F.lit(0).alias("_all"), F.least(F.lit(spans - 1), F.floor(F.col("finish") / F.lit(max(total, 1.0)) * spans)).alias("_span"))
    d = _running(d, ["_all", "_span"], ["finish", "source", "doc_id", "use"], "n_tokens", "_total")
    d = d.where(F.col("_total") <= total)
    return d.select(F.col("_total_rank").alias("position"), "doc_id", "source", "use", "n_tokens", F.round("finish", 3).alias("finish")), plan


def sized_documents(docs: DataFrame, path: str = f"{encode.TOKENIZERS}/{encode.DEFAULT}") -> DataFrame:
    """(doc_id, source, n_tokens), checkpointed because totals, offsets and order all read it (24 bytes a document)."""
    return cut_lineage(encode.count_tokens(docs, ["doc_id", "source"], path=path))


def shares(mixture: DataFrame, plan: list[dict]) -> DataFrame:
    """(source, target_share, weight, available_docs, available_tokens, used_docs, used_tokens, most_uses, actual_share) of every target source."""
    spark = mixture.sparkSession
    p = spark.createDataFrame(
        [(r["source"], r["target_share"], float(r["weight"]), int(r["docs"]), int(r["tokens"])) for r in plan],
        "source string, target_share double, weight double, available_docs bigint, available_tokens bigint",
    )
    got = mixture.groupBy("source").agg(F.countDistinct("doc_id").alias("used_docs"), F.sum("n_tokens").alias("used_tokens"), F.max("use").alias("most_uses"))
    j = p.join(got, "source", "left").na.fill(0, ["used_docs", "used_tokens", "most_uses"])
    # one row per source: the total over all of them is a small window
    whole = F.sum("used_tokens").over(Window.partitionBy())
    return j.withColumn("actual_share", F.round(F.try_divide(F.col("used_tokens").cast("double"), whole.cast("double")), 6))
