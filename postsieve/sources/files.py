"""Readers of posts, lexicons, label records and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fixed schema of label records; successes and errors share it.
LABEL_RECORD = "hash string, text string, is_coded string, domain string, mechanism string, confidence double, spans array<string>, decoded array<string>, reasoning string, needs_review boolean, model_used string"


def text_lines(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """(text) of the non-blank lines, outer white space stripped; ``tolerant`` replaces bytes that are no UTF-8."""
    v = F.make_valid_utf8("value") if tolerant else F.col("value")
    return spark.read.text(path).select(strip(v).alias("text")).where("text <> ''")


def text_buckets(spark: SparkSession, path: str, by: str = "label") -> DataFrame:
    """(by, value) of the lines below ``path``, one folder per value of ``by``."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/{by}=([^/]+)/", 1)
    return spark.read.schema("value string").option("recursiveFileLookup", True).text(path).select(F.url_decode(folder).alias(by), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with the physical line number over the files in name order, from one.

    Lines of a block are read in a row, so their distance from its first one is known;
    the counts of the blocks before it, one row per block, give its offset.
    """
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("_at"))
    blocks = d.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("f", "b", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return d.join(blocks, ["f", "b"]).select((F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def lexicon_with_lists(spark: SparkSession, path: str) -> DataFrame:
    """(term_ord, term, meaning) of a JSON object {term: [{"meaning": ...}, ...]}; other values have no meanings."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    terms = whole.select(F.posexplode(F.map_entries("m")).alias("term_ord", "e"))
    meanings = F.from_json(F.col("e.value"), "array<struct<meaning:string>>")
    return terms.select("term_ord", F.col("e.key").alias("term"), F.explode(meanings).alias("x")).select("term_ord", "term", "x.meaning").where("meaning <> ''")


def lexicon_flat(spark: SparkSession, path: str) -> DataFrame:
    """(term_ord, term, meaning) of a JSON object {term: meaning}; null becomes '', empty terms are dropped. A missing or broken file gives no rows."""
    try:
        whole = spark.read.text(path, wholetext=True)
        terms = whole.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("term_ord", "e"))
        terms = terms.select("term_ord", F.col("e.key").alias("term"), F.coalesce("e.value", F.lit("")).alias("meaning")).where("term <> ''")
        terms.limit(1).collect()  # a file that cannot be read fails here
        return terms
    except Exception:  # noqa: BLE001 - the lexicon is optional
        return spark.createDataFrame([], "term_ord int, term string, meaning string")


def label_records(spark: SparkSession, path: str, strict: bool = False, schema: str = LABEL_RECORD) -> DataFrame:
    """Label records of JSON lines. Strict fails on a bad line; else bad lines are kept apart in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    d = spark.read.text(path).where(F.trim("value") != "")
    is_object = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").isNotNull()
    return d.select(F.from_json("value", schema).alias("r"), F.when(~is_object, F.col("value")).alias("_corrupt_record")).select("r.*", "_corrupt_record")


def good_and_bad(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed records, and the text of the lines that were no JSON object. A record with a field of another type is a record, the field null."""
    bad = F.col("_corrupt_record").isNotNull()
    return records.where(~bad).drop("_corrupt_record"), records.where(bad).select("_corrupt_record")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = ["NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A", ""]
    return d.select(*[F.when(F.col(f"`{c}`").isin(missing), None).otherwise(F.col(f"`{c}`")).alias(c) for c in d.columns])


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
