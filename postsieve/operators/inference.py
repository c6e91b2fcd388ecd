"""Labelling of posts by a model given as a callable, with retries, fallback and isolation of errors per row.

``labeler(prompt, model, mode, **arguments)`` returns the model's raw text; mode is
'structured' or 'text', the arguments are those of the model's family. It runs
inside Arrow batches on the executors; a failure of one row becomes an error record,
never a failed task. Answers should be written once, before they are routed: a
labelled frame is not free to recompute.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .labels import answer_policy
from .matching import with_capped_hits

ANSWER = "hash string, text string, is_coded string, domain string, mechanism string, confidence double, spans array<string>, decoded array<string>, reasoning string, model_used string, model_actual string"
EMPTY_OUTPUT = ("Raw output: ''", 'Raw output: ""')
PROGRESS = 50  # rows between two reports of progress
CHUNK = 5000  # answers handed on at once


@dataclass(frozen=True)
class Options:
    model: str = "primary"
    second_model: str | None = None
    structured_attempts: int = 1
    max_retries: int = 5
    first_delay: float = 1.0
    most_delay: float = 60.0
    jitter: float = 0.5
    pause: float = 0.0  # seconds after each answer
    per_second: float | None = None  # most answers a partition asks for
    max_output_tokens: int = 400
    effort: str = "low"
    reasoning_family: str = "gpt-5"  # models whose names begin so take an effort instead of a temperature
    review_below: float = rules.REVIEW_BELOW

    def arguments(self, model: str) -> dict:
        """What a model's family takes besides the prompt."""
        own = {"reasoning": {"effort": self.effort}, "text": {"verbosity": "low"}} if model.lower().startswith(self.reasoning_family) else {"temperature": 0.2}
        return {"max_output_tokens": self.max_output_tokens, **own}


INSTRUCTIONS = (
    "Decide whether the post hides its meaning behind coded words: replacements, emoji, digits for letters, spacing or the like that keep it from being "
    "recognised. Judge the wording, not the subject; entries of the dictionary that occur in the post are hints and no proof. Answer with one JSON object "
    "and nothing else. Its fields: is_coded, domain and mechanism, each one of the values allowed below; confidence, a number from 0 to 1; spans, the coded "
    "parts of the post as written; decoded, what each of them means, in the same order; reason, one short sentence. If is_coded is no, domain is none, "
    "mechanism is other and decoded is empty. If in doubt, is_coded is unsure."
)


def prompt(text: Column, hits: Column) -> Column:
    """Prompt of a post, as JSON: what to do, the allowed values, the post, and the lexicon entries that occur in it."""
    allowed = F.struct(*[F.array(*map(F.lit, v)).alias(k) for k, v in (("is_coded", rules.ANSWERS), ("domain", rules.DOMAINS), ("mechanism", rules.MECHANISMS))])
    return F.to_json(F.struct(F.lit(INSTRUCTIONS).alias("instructions"), allowed.alias("allowed"), text.alias("post"), hits.alias("dictionary_hits")))


def parse_answer(raw: object) -> dict:
    """The first JSON object of a raw answer, validated; raises ValueError. What is no text counts as an empty output."""
    raw = raw if isinstance(raw, str) else ""
    found = re.search(r"\{.*\}", raw, re.S)
    if not found:
        raise ValueError(f"no JSON object. Raw output: {raw[:600]!r}")
    o = json.loads(found.group())
    strings = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    ok = (
        o.get("is_coded") in rules.ANSWERS
        and o.get("domain") in rules.DOMAINS
        and o.get("mechanism") in rules.MECHANISMS
        and isinstance(o.get("confidence"), (int, float))
        and 0 <= o["confidence"] <= 1
        and strings(o.get("spans", []))
        and strings(o.get("decoded", []))
        and isinstance(o.get("reason"), str)
    )
    if not ok:
        raise ValueError(f"invalid answer. Raw output: {raw[:600]!r}")
    return o


def ask(labeler: Callable[..., object], text: str, model: str, o: Options) -> dict:
    """Structured attempts, then one in plain text."""
    for _ in range(o.structured_attempts):
        try:
            return parse_answer(labeler(text, model, "structured", **o.arguments(model)))
        except Exception:  # noqa: BLE001, S110 - any failure leads to the next attempt
            pass
    return parse_answer(labeler(text, model, "text", **o.arguments(model)))


def ask_with_retry(labeler: Callable[..., object], text: str, model: str, o: Options, rng: random.Random) -> dict:
    delay = o.first_delay
    for attempt in range(o.max_retries):
        try:
            return ask(labeler, text, model, o)
        except Exception:
            if attempt + 1 == o.max_retries:
                raise
            time.sleep(delay + rng.uniform(0, o.jitter))
            delay = min(delay * 2, o.most_delay)
    raise ValueError("no attempts allowed")


def ask_in_turn(labeler: Callable[..., object], text: str, o: Options, rng: random.Random) -> tuple[dict, str]:
    """The second model answers only if the first gave an empty output to the end."""
    try:
        return ask_with_retry(labeler, text, o.model, o, rng), o.model
    except Exception as e:
        if o.second_model and any(x in str(e) for x in EMPTY_OUTPUT):
            return ask_with_retry(labeler, text, o.second_model, o, rng), o.second_model
        raise


def label(posts: DataFrame, labeler: Callable[..., object], lexicon: DataFrame, o: Options = Options(), max_hits: int = 8, progress=None) -> DataFrame:
    """Label records of posts (text[, n_copies]), successes and errors alike, with review flag and bucket.

    A text is asked about once per copy until it is answered; each failure is an
    error record. ``progress`` is an accumulator to which every PROGRESS rows add.
    """
    copies = F.col("n_copies").cast("bigint") if "n_copies" in posts.columns else F.lit(1).cast("bigint")
    p = with_capped_hits(posts.select("text", copies.alias("n_copies")), lexicon, max_hits)
    p = p.select("text", "n_copies", prompt(F.col("text"), F.col("hits")).alias("prompt"))
    columns = [c.split()[0] for c in ANSWER.split(", ")]

    def one(text: str, q: str, rng: random.Random) -> tuple:
        try:
            a, who = ask_in_turn(labeler, q, o, rng)
            h = hashlib.sha1(text.encode("utf-8", "ignore"), usedforsecurity=False).hexdigest()
            return (h, text, a["is_coded"], a["domain"], a["mechanism"], float(a["confidence"]), a.get("spans", []), a.get("decoded", []), a["reason"], o.model, who)
        except Exception as e:  # noqa: BLE001 - isolated per row
            return (None, text, "error", None, None, 0.0, None, None, f"LLM labeling failed: {str(e)[:200]}", o.model, None)

    def op(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, asked, began, out = random.Random(1), 0, time.monotonic(), []
        for b in batches:
            for text, n, q in zip(b["text"], b["n_copies"], b["prompt"]):
                for _ in range(n):
                    out.append(one(text, q, rng))
                    asked += 1
                    if o.per_second:
                        time.sleep(max(0.0, began + asked / o.per_second - time.monotonic()))
                    if o.pause and out[-1][2] != "error":
                        time.sleep(o.pause)
                    if progress is not None and asked % PROGRESS == 0:
                        progress.add(PROGRESS)
                    if out[-1][2] != "error":
                        break
                    if len(out) >= CHUNK:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        yield pd.DataFrame(out, columns=columns)

    answered = p.mapInPandas(op, ANSWER)
    a = answer_policy(answered, o.review_below)
    error = F.col("is_coded") == "error"
    return a.withColumns({"needs_review": F.when(error, True).otherwise(F.col("needs_review")), "bucket": F.when(error, F.lit(None)).otherwise(F.col("bucket"))})
