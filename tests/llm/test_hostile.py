"""Very long and hostile texts: every operator ends, and soon."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from postsieve.llm import dupes, encode, language, lookalike, nearup, pii, quality, toxic

N = 60_000
TEXTS = [
    "1" * N + "a", "*" * N, "a1" * N, "> " * N, "a: b|" * N, "#" * N, " " * N + "x", "+1 (5" * N, "a." * N, "((((" * N, "@" * N, "x@" * N, "at dot " * N, "a b " * N, "é" * N, "ﬁ" * N, "​" * N, "\n" * N + "a", "- a\n" * N, "www." * N, "😂" * N,
    "1 2 3 4 5 6 " * N, "1-" * N, "via " * N, "'" * N, "rue " * N, "Ab" * N, "A. " * N, ". a" * N, "=" * N + "?", "\t|" * N,
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_python_operators_end(k):
    began = time.perf_counter()
    t = TEXTS[k]
    language.Decoder(language.Crf()).batch([t])
    toxic.Scorer({"a": 1.0}).scores(t)
    list(pii.propose(t))
    lookalike.Normaliser({}).text(t)
    nearup.Shingler().runs([t])
    encode.Encoder().batch([t])
    assert time.perf_counter() - began < 20


def test_columns_end(spark):
    d = spark.createDataFrame([("t", i, t) for i, t in enumerate(TEXTS)], "tab string, id int, text string").repartition(4)
    assert dupes.copies(d.unionByName(d.withColumn("id", F.col("id") + 100))).count() >= len(TEXTS) - 1
    assert quality.verdicts(quality.statistics(d, "id")).count() == len(TEXTS)
