"""python -m postsieve.export {posts,csv,coded} INPUT --output PATH [--report PATH]: exports of label records (JSON lines).

posts: the posts answered yes or unsure as a JSON array, and their printable report;
csv: all records in the spreadsheet dialect, known columns first; coded: the
rule-labelled records with coded hits, as JSON lines.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import export
from .session import build_session
from .sources import files, writers

CODED = "text string, label string, confidence double, reasons array<string>, moderation_hits array<struct<kind:string,category:string,token:string,meaning:string>>, coded_hits array<struct<kind:string,category:string,token:string,meaning:string>>"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Label records with the number of their line and the keys they have; lines that are no records are left out."""
    lines = files.numbered_lines(spark, path).withColumn("r", F.from_json("value", files.LABEL_RECORD))
    good = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").isNotNull()
    return lines.where(good).select("line", F.json_object_keys("value").alias("keys"), "r.*")


def run(spark: SparkSession, what: str, source: str, output: str | None = None, report: str | None = None) -> int:
    """Writes the export and returns its number of records."""
    if what == "coded":
        d = files.good_and_bad(files.label_records(spark, source, schema=CODED))[0].where(F.size("coded_hits") > 0)
        if output:
            writers.json_lines(d, output)
    elif what == "csv":
        d = _records(spark, source).drop("line", "keys")
        if output:
            writers.csv_records(d, output)
    else:
        d = export.extracted_posts(_records(spark, source), keys="keys")
        if output:
            writers.json_array(export.json_array(d), output)
        if report:
            writers.report(export.report_blocks(d), report)
    return d.count()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="postsieve.export", description=__doc__.split("\n")[0])
    p.add_argument("what", choices=["posts", "csv", "coded"])
    p.add_argument("input", help="label records, one JSON object per line")
    p.add_argument("--output", "-o")
    p.add_argument("--report", "-s", help="printable report of posts")
    a = p.parse_args(arguments)
    n = run(spark or build_session(), a.what, a.input, a.output, a.report)
    print(f"{n} records")
    return n


if __name__ == "__main__":
    main()
