"""Queries that write with a sink and read back with a source, and their SQL over what was written."""

from __future__ import annotations

import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.language import languages_of
from ..operators import export, labels
from ..session import scratch, table
from ..sources import files, writers
from ..streaming import collector
from .reference_oracles import _BLOCKS, _EXTRACT, _STRIP, ORACLES as REFERENCE


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "llm_labeled_posts").select("record_id", *rules.EXPORT_COLUMNS)


def _listed(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.array_join(c, ",") for c in ("spans", "decoded")})


def text_buckets_read(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by label, from the folders of the labels."""
    writers.text_buckets(table(spark, sf, "labeled_posts").where("text IS NOT NULL AND label IS NOT NULL"), out := scratch(spark))
    return files.text_buckets(spark, out)


def text_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "combined").where("text IS NOT NULL").select("text").write.text(out := scratch(spark))
    return files.text_lines(spark, out)


def text_lines_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that end in bytes which are no UTF-8, replaced as they are read."""
    broken = F.concat(F.regexp_replace("text", r"[\r\n]", " "), F.unhex(F.lit("E9FF")).cast("string"), F.lit("!"))
    table(spark, sf, "combined").where("text IS NOT NULL").select(broken.alias("value")).write.text(out := scratch(spark))
    return files.text_lines(spark, out, tolerant=True)


def _lexicon_file(spark: SparkSession, sf: str, value) -> str:
    """The lexicon, small by nature, as one JSON object in the order of its terms."""
    rows = list({r["term"]: r for r in reversed(table(spark, sf, "lexicon").where("term IS NOT NULL").orderBy("term_ord").limit(50_000).collect())}.values())[::-1]
    body = F.map_from_arrays(F.array(*[F.lit(r["term"]) for r in rows]), F.array(*[value(r["meaning"]) for r in rows])) if rows else F.create_map().cast("map<string,string>")
    spark.range(1).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).write.text(out := scratch(spark))
    return out


def lexicon_lists_read(spark: SparkSession, sf: str) -> DataFrame:
    return files.lexicon_with_lists(spark, _lexicon_file(spark, sf, lambda m: F.array(F.struct(F.lit(m).cast("string").alias("meaning")))))


def lexicon_flat_read(spark: SparkSession, sf: str) -> DataFrame:
    return files.lexicon_flat(spark, _lexicon_file(spark, sf, lambda m: F.lit(m).cast("string")))


def json_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    writers.json_lines(_records(spark, sf).drop("record_id"), out := scratch(spark))
    return _listed(files.label_records(spark, out, strict=True))


def broken_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    """Label lines as written, read tolerantly: the texts of the records, and the lines that are none."""
    table(spark, sf, "label_lines").where("raw <> ''").select("raw").write.text(out := scratch(spark))
    good, bad = files.good_and_bad(files.label_records(spark, out))
    return good.select(F.lit("good").alias("kind"), F.col("text").alias("value")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("_corrupt_record").alias("value")))


def numbered_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    """Physical line numbers over several files."""
    table(spark, sf, "label_lines").orderBy("record_id").select(F.coalesce("raw", F.lit(""))).write.text(out := scratch(spark))
    return files.numbered_lines(spark, out)


def appended_run_read(spark: SparkSession, sf: str) -> DataFrame:
    """A labelling run written anew and once more: texts per bucket, and records."""
    run = labels.answer_policy(_records(spark, sf).where("is_coded <> 'error' AND text <> ''").drop("record_id", "needs_review"))
    out = scratch(spark)
    writers.labelled_run(run, out, overwrite=True)
    writers.labelled_run(run, out)
    texts = files.text_buckets(spark, f"{out}/buckets", "bucket").groupBy("bucket").agg(F.count("*").alias("n"))
    return texts.unionByName(spark.read.schema(files.LABEL_RECORD).json(f"{out}/records").agg(F.count("*").alias("n")).select(F.lit("records").alias("bucket"), "n"))


def csv_read(spark: SparkSession, sf: str) -> DataFrame:
    writers.csv_records(_records(spark, sf).drop("record_id").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " ")), out := scratch(spark))
    return files.csv_table(spark, out)


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return export.extracted_posts(_records(spark, sf).withColumnRenamed("record_id", "line"))


def report_read(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the printed report, from its file."""
    writers.report(export.report_blocks(_extracted(spark, sf)), out := scratch(spark))
    return spark.read.text(out)


def json_array_read(spark: SparkSession, sf: str) -> DataFrame:
    e = _extracted(spark, sf)
    writers.json_array(export.json_array(e), out := scratch(spark), one_file=True)
    return spark.read.schema(e.schema).json(out, multiLine=True).withColumns({c: F.array_join(c, ", ") for c in ("spans", "decoded")})


def parquet_read(spark: SparkSession, sf: str) -> DataFrame:
    writers.parquet(table(spark, sf, "hatebase_cleaned"), out := scratch(spark))
    return files.parquet_table(spark, out).select("tweet_id", "tweet", "class", "data")


def _streamed(spark: SparkSession, sf: str, most: int | None, language) -> DataFrame:
    """Posts of recorded events, through the stream and its text sink."""
    record = F.struct(F.lit(collector.POST_TYPE).alias("$type"), F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    events = table(spark, sf, "combined").select("row_id", F.to_json(F.struct(F.struct(record.alias("record")).alias("commit"))).alias("value"))
    out = scratch(spark)
    events.repartitionByRange(1, "row_id").sortWithinPartitions("row_id").select("value").write.text(f"{out}/events")
    recorded = sorted(glob.glob(f"{out.removeprefix('file:')}/events/part-*"))[0]  # the replay source reads one local file
    q = collector.collect(collector.posts_of(collector.replay(spark, recorded, 20_000), language), f"{out}/posts", most=most, checkpoint=f"{out}/state")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("value string").text(f"{out}/posts")


def streamed_english(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, None, languages_of)


def streamed_first(spark: SparkSession, sf: str) -> DataFrame:
    """The stream stops after 50 posts."""
    return _streamed(spark, sf, 50, None)


QUERIES = {
    f.__name__: f
    for f in (
        text_buckets_read, text_lines_read, text_lines_repaired, lexicon_lists_read, lexicon_flat_read, json_lines_read, broken_lines_read, numbered_lines_read, appended_run_read, csv_read,
        report_read, json_array_read, parquet_read, streamed_english, streamed_first,
    )
}

_LINE = r"unnest(string_split_regex(text, '\r\n|\n|\r'))"
_TEXT_FIELD = "nullif({0}, '') AS {0}"
_ONE_LINE = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g')"
ORACLES = {
    "text_buckets_read": r"SELECT label, regexp_replace(text, '[\r\n]+', ' ', 'g') AS value FROM labeled_posts WHERE text IS NOT NULL AND label IS NOT NULL",
    "text_lines_read": f"SELECT text FROM (SELECT regexp_replace(line, '{_STRIP}', '', 'g') AS text FROM (SELECT {_LINE} AS line FROM combined)) WHERE text <> ''",
    "text_lines_repaired": rf"SELECT regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g') || chr(65533) || chr(65533) || '!', '{_STRIP}', '', 'g') AS text FROM combined WHERE text IS NOT NULL",
    "lexicon_lists_read": "SELECT * FROM (SELECT row_number() OVER (ORDER BY term_ord)::INTEGER - 1 AS term_ord, term, meaning FROM lexicon WHERE term IS NOT NULL) WHERE meaning <> ''",
    "lexicon_flat_read": "SELECT * FROM (SELECT row_number() OVER (ORDER BY term_ord)::INTEGER - 1 AS term_ord, term, coalesce(meaning, '') AS meaning FROM lexicon WHERE term IS NOT NULL) WHERE term <> ''",
    "json_lines_read": f"SELECT {', '.join(f'''array_to_string({c}, ',') AS {c}''' if c in ('spans', 'decoded') else c for c in rules.EXPORT_COLUMNS)} FROM llm_labeled_posts",
    "broken_lines_read": """SELECT CASE WHEN json_valid(raw) THEN 'good' ELSE 'bad' END AS kind, CASE WHEN json_valid(raw) THEN raw ->> '$.text' ELSE raw END AS value FROM label_lines WHERE raw <> ''""",
    "numbered_lines_read": "SELECT row_number() OVER (ORDER BY record_id) AS line, coalesce(raw, '') AS value FROM label_lines",
    "appended_run_read": """WITH a AS (SELECT CASE WHEN is_coded = 'unsure' OR confidence < 0.65 THEN 'review' WHEN is_coded IN ('yes', 'no') THEN is_coded ELSE 'review' END AS bucket FROM llm_labeled_posts WHERE is_coded <> 'error' AND text <> '')
SELECT bucket, 2 * count(*) AS n FROM a GROUP BY bucket UNION ALL SELECT 'records', 2 * count(*) FROM a""",
    "csv_read": rf"""WITH f AS ({REFERENCE["csv_projection"]})
SELECT {', '.join(r"nullif(regexp_replace(text, '[\r\n]+', ' ', 'g'), '') AS text" if c == 'text' else _TEXT_FIELD.format(c) for c in rules.EXPORT_COLUMNS)} FROM f""",
    "report_read": rf"WITH {_EXTRACT}, {_BLOCKS} SELECT unnest(string_split_regex(block, '\r\n|\n|\r')) AS value FROM blocks",
    "json_array_read": REFERENCE["extracted_posts"],
    "parquet_read": "SELECT tweet_id, tweet, class, data FROM hatebase_cleaned",
    "streamed_english": f"SELECT replace(text, chr(10), ' ') AS value FROM ({REFERENCE['english_posts'].replace('FROM combined', f'FROM (SELECT row_id, {_ONE_LINE} AS text FROM combined)')})",
    "streamed_first": f"SELECT replace({_ONE_LINE}, chr(10), ' ') AS value FROM combined WHERE text <> '' ORDER BY row_id LIMIT 50",
}
