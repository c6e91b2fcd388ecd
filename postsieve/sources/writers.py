"""Writers of posts, label records, reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import csv_projection


def text_buckets(posts: DataFrame, path: str, by: str = "label", mode: str = "overwrite") -> None:
    """One folder of text lines per value of ``by``."""
    posts.select(F.col(by), F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode(mode).partitionBy(by).text(path)


def json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with explicit nulls."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV in the spreadsheet dialect, known columns first."""
    csv_projection(records).write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="", lineSep="\r\n"
    ).csv(path)


def report(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text files which in name order are the report of ``export.report_blocks``."""
    blocks.orderBy("post_no").select("block").write.mode(mode).text(path)


def json_array(lines: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """Text files which in name order are the JSON array of ``export.json_array``; one file for exports of a bounded size only."""
    d = lines.repartitionByRange(1, "row_no").sortWithinPartitions("row_no") if one_file else lines.orderBy("row_no")
    d.select("value").write.mode(mode).text(path)


def parquet(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def labelled_run(labelled: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Appends a labelling run: its records, and the text of each bucket. ``overwrite`` starts both anew.

    The records are written first and read again, so that inference runs once.
    """
    mode = "overwrite" if overwrite else "append"
    spark = labelled.sparkSession
    staged = f"{folder}/_last_run"
    labelled.write.mode("overwrite").parquet(staged)
    run = spark.read.parquet(staged)
    json_lines(run.drop("bucket"), f"{folder}/records", mode)
    text_buckets(run.where("bucket IS NOT NULL"), f"{folder}/buckets", "bucket", mode)
