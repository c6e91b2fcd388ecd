"""Queries of the labelling, screening, cleaning, reporting and export operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import languages_of
from ..functions.text import content_hash, with_forms
from ..operators import dedupe, export, inference, labels, matching, profile, screening
from ..session import spread, table, where_computed


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "combined").select("row_id", "text")


def _tweets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hatebase_cleaned").select("tweet_id", "tweet", "class", "data")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "llm_labeled_posts")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_posts(spread(_posts(spark, sf)), "row_id", table(spark, sf, "lexicon"))


def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    tokens = lambda c: F.array_join(F.transform(c, lambda h: F.concat_ws(":", h["category"], h["token"], h["meaning"])), ";")
    return _labelled(spark, sf).select(
        "row_id", "label", "confidence", F.array_join("reasons", ",").alias("reasons"), tokens("moderation_hits").alias("moderation"), tokens("coded_hits").alias("coded")
    )


def rule_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf)
    return d.agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("clean", "questionable", "moderated")])


def moderation_hits_by_category(spark: SparkSession, sf: str) -> DataFrame:
    n = with_forms(spread(_posts(spark, sf)))
    h = n.select(F.explode(matching.moderation_hits(F.col("norm"), F.col("probe"))).alias("h"))
    return h.groupBy(F.col("h.category").alias("category"), F.col("h.token").alias("token")).agg(F.count("*").alias("n"))


def lexicon_hits(spark: SparkSession, sf: str) -> DataFrame:
    d = matching.match_posts(spread(_posts(spark, sf)), "row_id", table(spark, sf, "lexicon"))
    return d.select("row_id", F.explode("coded_hits").alias("h")).select("row_id", "h.category", "h.token", "h.meaning")


def lexicon_hits_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the join that larger lexicons take."""
    d = matching.match_posts(spread(_posts(spark, sf)), "row_id", table(spark, sf, "lexicon"), inline=0)
    return d.select("row_id", F.explode("coded_hits").alias("h")).select("row_id", "h.category", "h.token", "h.meaning")


def _capped(spark: SparkSession, sf: str, **how) -> DataFrame:
    d = matching.with_capped_hits(_posts(spark, sf), table(spark, sf, "lexicon"), 2, **how)
    d = d.select("row_id", F.array_join(F.transform("hits", lambda h: F.concat_ws("=", h["token"], h["meaning"])), ";").alias("hits"))
    return where_computed(d, F.col("hits") != "")


def lexicon_hits_capped(spark: SparkSession, sf: str) -> DataFrame:
    return _capped(spark, sf)


def lexicon_hits_capped_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the join that larger lexicons take."""
    return _capped(spark, sf, inline=0)


def meaning_categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lexicon").select("term_ord", "term", matching.meaning_category(F.col("meaning")).alias("category"))


def garbage_filter(spark: SparkSession, sf: str) -> DataFrame:
    return where_computed(screening.with_garbage_rule(spread(_posts(spark, sf))).select("row_id", "rule"), F.col("rule").isNotNull())


def garbage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return screening.with_garbage_rule(spread(_posts(spark, sf))).agg(F.count("*").alias("n_input"), F.count_if(F.col("rule").isNull()).alias("n_kept"))


def _loose() -> object:
    return dedupe.loose_key(F.col("text"))


def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.keep_first(_posts(spark, sf), _loose(), "row_id").select("row_id", "text")


def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.repeated_rows(_posts(spark, sf), _loose()).select("row_id")


def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.excess_rows(_posts(spark, sf), _loose())


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_counts(table(spark, sf, "combined"))


def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shape(_tweets(spark, sf))


def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distribution(_tweets(spark, sf), "class")


def source_class_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return profile.crosstab(_tweets(spark, sf), "data", "class")


def source_class_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return profile.pivot_counts(_tweets(spark, sf), "data", "class")


def source_class_long(spark: SparkSession, sf: str) -> DataFrame:
    return profile.crosstab_long(_tweets(spark, sf), "data", "class")


def source_class_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Counts joined with their percents by source."""
    t = profile.crosstab(_tweets(spark, sf), "data", "class")
    counts, percents = t.select("data", "safe", "unsafe", "total"), t.select("data", F.col("safe_pct").alias("safe"), F.col("unsafe_pct").alias("unsafe"))
    return counts.join(profile.suffixed(percents, "_pct", ("data",)), "data", "left")


def before_after_histogram(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labeled_posts").select("post_id", "text", "label")
    return profile.before_after(d, dedupe.keep_first(d, dedupe.loose_key(F.col("text")), "post_id"), "label")


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return profile.search(_tweets(spark, sf), "lighthouse|velk", "tweet")


def keyword_search_top(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top(profile.search(_tweets(spark, sf), "next to the gym", "tweet", literal=True), "tweet_id", 100).select("tweet_id", "class", "data")


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top(_tweets(spark, sf), "tweet_id", 5)


def random_examples(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample(_tweets(spark, sf).where("class = 'unsafe'").select("tweet", "data"), 20)


def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_values(_tweets(spark, sf), "data")


def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    parts = [(_tweets(spark, sf), {"tweet": "text"}, {"data": "hatebase"}), (table(spark, sf, "labeled_posts"), {"text": "text"}, {"data": "bluesky"})]
    return profile.tagged_union(parts)


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose text no label record answers yet, the first of each text."""
    posts = table(spark, sf, "labeled_posts").select("post_id", "text").where("text IS NOT NULL")
    return dedupe.pending(posts, _records(spark, sf), "post_id").select("post_id", "hash")


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _posts(spark, sf).select("row_id", content_hash(F.col("text")).alias("hash"))


def coded_only(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_posts").where(F.size("coded_hits") > 0).select("post_id", "label", F.size("coded_hits").alias("n_hits"))


def review_buckets(spark: SparkSession, sf: str) -> DataFrame:
    r = labels.answer_policy(_records(spark, sf).where("is_coded <> 'error'").select("record_id", "is_coded", "domain", "mechanism", "confidence", "decoded"))
    return r.select("record_id", "domain", "mechanism", F.size("decoded").alias("n_decoded"), "needs_review", "bucket")


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf).withColumn("bucket", labels.bucket(F.col("is_coded"), F.col("needs_review")))
    return labels.run_counters(r)


def csv_projection(spark: SparkSession, sf: str) -> DataFrame:
    return export.csv_projection(_records(spark, sf).drop("written_at"))


def extracted_posts(spark: SparkSession, sf: str) -> DataFrame:
    e = export.extracted_posts(_records(spark, sf).withColumnRenamed("record_id", "line"))
    return e.withColumns({c: F.array_join(c, ", ") for c in ("spans", "decoded")})


def extracted_report(spark: SparkSession, sf: str) -> DataFrame:
    return export.report_blocks(export.extracted_posts(_records(spark, sf).withColumnRenamed("record_id", "line")))


def line_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Tolerant reading of label lines: parsed and bad lines per run."""
    d = table(spark, sf, "label_lines").select("run_id", F.try_parse_json("raw").isNotNull().alias("ok"))
    return d.groupBy("run_id").agg(F.count_if("ok").alias("n_parsed"), F.count_if(~F.col("ok")).alias("n_bad"))


def record_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the keys of all label lines."""
    return table(spark, sf, "label_lines").select(F.explode(F.json_object_keys("raw")).alias("key")).distinct()


def nested_events(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of nested events, made from the combined texts; those of one source are posts."""
    from ..streaming.collector import POST_TYPE, posts_of

    kind = F.when(F.lower(F.trim("data")) == "bluesky", POST_TYPE).otherwise("like")
    record = F.struct(kind.alias("$type"), F.col("text").alias("text"))
    return posts_of(table(spark, sf, "combined").select(F.to_json(F.struct(F.struct(record.alias("record")).alias("commit"))).alias("value")))


def english_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Nested events in English by function words, as the stream keeps them."""
    from ..streaming.collector import POST_TYPE, posts_of

    record = F.struct(F.lit(POST_TYPE).alias("$type"), F.col("text").alias("text"))
    return posts_of(table(spark, sf, "combined").select(F.to_json(F.struct(F.struct(record.alias("record")).alias("commit"))).alias("value")), languages_of)


def stub_labeler(q: str, model: str, mode: str, **arguments) -> str:
    """A deterministic model for tests and the bench; fails on every 11th length of a post in structured mode, for good on every 97th."""
    n = len(json.loads(q)["post"])
    if n % 89 == 0 and model != "second":
        return ""
    if mode == "structured" and n % 11 == 0:
        return "no answer"
    if n % 97 == 0:
        return "broken {"
    a = {"is_coded": ("yes", "no", "unsure")[n % 3], "domain": "hate", "mechanism": "masking", "confidence": (n % 10) / 10, "spans": [], "decoded": ["x"], "reason": f"{mode} {arguments['max_output_tokens']}"}
    return f"Well: {json.dumps(a)} that is it"


STUB = inference.Options(max_retries=2, first_delay=0.0, jitter=0.0, second_model="second")


def model_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Model labelling of the screened posts with the stub model."""
    posts = screening.screen(_posts(spark, sf))
    d = inference.label(posts, stub_labeler, table(spark, sf, "lexicon"), STUB)
    return d.withColumns({c: F.array_join(c, ",") for c in ("spans", "decoded")})


def model_labels_per_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a labelling run by answer: a text is asked about once per copy until one is answered."""
    posts = table(spark, sf, "labeled_posts").select("post_id", "text").where("text <> ''")
    d = inference.label(dedupe.pending(posts, _records(spark, sf).limit(0), "post_id"), stub_labeler, table(spark, sf, "lexicon"), STUB)
    return d.groupBy("is_coded").agg(F.count("*").alias("n_records"), F.countDistinct("text").alias("n_texts"))


def model_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What a prompt asks about each post, and what it allows."""
    p = matching.with_capped_hits(_posts(spark, sf), table(spark, sf, "lexicon"))
    q = F.from_json(inference.prompt(F.col("text"), F.col("hits")), "struct<instructions:string,allowed:struct<is_coded:array<string>,domain:array<string>,mechanism:array<string>>,post:string,dictionary_hits:array<struct<token:string,meaning:string>>>")
    p = p.select("row_id", q.alias("q"))
    return p.select("row_id", F.col("q.post").alias("post"), F.array_join("q.allowed.domain", ",").alias("domains"), F.size("q.dictionary_hits").alias("n_hits"), (F.length("q.instructions") > 200).alias("instructed"))


def sample_size(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a random sample, and those of them that are in the table: the feature is the limit."""
    t = _tweets(spark, sf).where("class = 'unsafe'").select("tweet_id")
    return profile.sample(t, 20).join(t, "tweet_id").agg(F.count("*").alias("n_rows"), F.countDistinct("tweet_id").alias("n_distinct"))


def screened_top(spark: SparkSession, sf: str) -> DataFrame:
    """The first posts that stay after screening."""
    return profile.top(screening.screen(_posts(spark, sf)), "row_id", 50).select("row_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        rule_labels, rule_label_counts, moderation_hits_by_category, lexicon_hits, lexicon_hits_joined, lexicon_hits_capped, lexicon_hits_capped_joined, meaning_categories, garbage_filter, garbage_counts,
        dedupe_keep_first, duplicate_groups, duplicate_count, null_profile, table_shape, class_distribution, source_class_crosstab, source_class_pivot, source_class_long,
        source_class_joined, before_after_histogram, keyword_search, keyword_search_top, first_rows, random_examples, distinct_sources, tagged_union, resume_pending,
        content_hashes, coded_only, review_buckets, run_counters, csv_projection, extracted_posts, extracted_report, line_parsing, record_keys, nested_events, english_posts, model_labels, model_labels_per_copy, model_prompts, sample_size, screened_top,
    )
}
