"""Abusive, hateful or sexual content.

Every token gets a log-odds score between unsafe and safe texts, from counts of
words and word pairs over all labelled rows with an informative Dirichlet prior
(the whole corpus as background, coded terms of the lexicon and a few plain
insults as pseudo-counts). A linear scan finds every maximal scoring segment of
a text. Extreme-value statistics calibrate the scores: the best segment of n
background tokens exceeds S with probability 1 - exp(-K n exp(-lambda S)), with
lambda and K from the token scores of safe texts. All segments of a text count: the
r best are judged together by the law of the sum of their normalised scores
(Karlin and Altschul 1993), each further segment at half the weight, and the most
significant r decides. A text is toxic below the probability ALPHA; its passages are
the segments of that r.

Disguises are folded before scoring: spaced or dotted letters are joined,
digits and symbols in place of letters are read as letters, masked, repeated,
dropped or added letters are resolved against the words that mark unsafe texts.

Labels may be wrong: counts only need most of them to be right, and safe rows
with an extreme score are left out of the calibration.

Bounds: the model keeps every word and pair of the whole corpus with evidence of
either class (MIN_COUNT, MIN_Z); more than MAX_TERMS of them, or more than
MAX_LEXICON harmful terms of the lexicon, are an error.

Defined cases: null, empty and blank texts score 0 with probability 1; null or
unknown labels are not counted; without rows of both labels only the prior
scores; equal segments are decided for the earlier; texts are read whole;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lookalike import skeleton

PRIOR = 4000.0  # weight of the background prior, in tokens
MAX_TERMS = 1_000_000
MAX_LEXICON = 50_000
MIN_COUNT, MIN_Z = 4, 1.9
DRIFT = 0.45  # taken from every token's log-odds: background segments lose
UNKNOWN = -0.35  # score of a token without evidence
CLIP = 4.0
ALPHA = 6e-5
FLUSH = 300_000  # terms counted by a task before they are handed on

#: Plain insults and sexual words (pseudo-counts), and letters written as digits or symbols.
SEED_WORDS = (
    "idiot idiots moron morons stupid worthless disgusting pathetic loser scum vermin trash filth filthy coward creep parasite brainless failure "
    "idiota imbécil asqueroso parásito basura dreckskerl abschaum wertloser versager imbécile déchet ordure lixo nojento inútil verme sukkel waardeloos smeerlap porn nudes xxx"
)
SEED_COUNT = 2.0
LEET = str.maketrans("0134578$@!€+", "oieastbsaiet")
#: What a coded term must mean to count as harmful.
HARMFUL = r"(?i)\b(insult|slur|stupid|suicide|kill|murder|assault|shoot|stab|rape|racist|supremacist|nazi|porn|sex|nude|naked)"

_NOISE = re.compile(r"(?:https?://|www\.)\S+|(?<![\w.+-])[\w.+-]++@[\w-]+\.\w+|(?<![\w$])[@#][a-z_]{3,}\b|^rt\b")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:([ .*·_-])[^\W_])(?:\1[^\W_])+(?!\w)")
#: The last alternative has no group: runs of signs are no token, and are passed over as a whole.
_TOKEN = re.compile(r"([^\W_](?:[\w$@!€+*#%'’.-]*[\w$@€+*#%])?|[$@*#%_](?:[!+*#%.-]*+[\w$@€])++|[\U0001F300-\U0001FAFF])|[$@*#%_!+.-]++")
_STRANGE = re.compile(r"[Ͱ-ϿЀ-ӿ԰-֏​-‏⁠-⁤＀-￯﻿­]")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_MASK = re.compile(r"[*#%_.+-]")
START = "<s>"


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; links, handles and tags left out, separated letters joined."""
    t = text.lower()
    if not t.isascii() and _STRANGE.search(t):
        t = skeleton(t).lower()
    if "@" in t or "#" in t or "://" in t or t.startswith("rt "):
        t = _NOISE.sub(" ", t)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: "".join(c for c in m.group() if c.isalnum()), t)
    return [x for x in _TOKEN.findall(t) if x]


def fold(token: str) -> str:
    """A token with digits and symbols read as letters; numbers become one token, masks stay as ?."""
    if _PLAIN.match(token):
        return token
    token = token.strip("'’.-")
    if not any(c.isalpha() for c in token):
        return "<num>" if token[:1].isdigit() else token
    if "'" in token or "’" in token:
        return token.replace("’", "'")
    t = token.translate(LEET).rstrip("!")
    return t if _PLAIN.match(t) else _MASK.sub("?", t)


def terms_of(text: str) -> list[str]:
    """Words and pairs of a text, pairs joined by a space."""
    w = [fold(t) for t in tokens_of(text)]
    return w + [f"{a} {b}" for a, b in zip([START, *w], w)]


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, safe, unsafe) over all rows (text, class); tasks count first, then counts are summed."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: tuple[Counter, Counter]) -> pa.RecordBatch:
            keys = list(c[0].keys() | c[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x[k] for k in keys], pa.int64()) for x in c)], ["term", "safe", "unsafe"])

        c: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c[label].update(terms_of(text))
            if len(c[0]) + len(c[1]) > FLUSH:
                yield out(c)
                c = (Counter(), Counter())
        if c[0] or c[1]:
            yield out(c)

    y = F.when(F.lower(F.trim("class")) == "unsafe", 1).when(F.lower(F.trim("class")) == "safe", 0)
    rows = labelled.select("text", y.cast("int").alias("y")).where("y IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(op, "term string, safe bigint, unsafe bigint").groupBy("term").agg(F.sum("safe").alias("safe"), F.sum("unsafe").alias("unsafe"))
    return cut_lineage(counts)  # totals and log-odds read it


def log_odds(counts: DataFrame, prior_terms: list[str], limit: int = MAX_TERMS) -> dict[str, float]:
    """Term -> log-odds of unsafe against safe, for every significant term of the corpus."""
    pair = F.col("term").contains(" ")
    total = {r[0]: (r[1] or 0, r[2] or 0) for r in counts.groupBy(pair.alias("pair")).agg(F.sum("safe"), F.sum("unsafe")).collect()}
    seeds = {**dict.fromkeys(SEED_WORDS.split(), SEED_COUNT), **dict.fromkeys(prior_terms, 2 * SEED_COUNT)}
    spark = counts.sparkSession
    s = spark.createDataFrame([(k, float(v)) for k, v in sorted(seeds.items())], "term string, seed double")
    c = counts.join(F.broadcast(s), "term", "full").na.fill(0)
    n0 = F.when(pair, total.get(True, (0, 0))[0]).otherwise(total.get(False, (0, 0))[0]) + 1.0
    n1 = F.when(pair, total.get(True, (0, 0))[1]).otherwise(total.get(False, (0, 0))[1]) + 1.0
    # a term's background counts, split between the classes as chance would
    a = F.lit(PRIOR) * (F.col("safe") + F.col("unsafe") + 0.1) / (n0 + n1)
    y1, y0 = F.col("unsafe") + a * n1 / (n0 + n1) + F.col("seed"), F.col("safe") + a * n0 / (n0 + n1)
    t1, t0 = n1 * (1 + PRIOR / (n0 + n1)), n0 * (1 + PRIOR / (n0 + n1))
    delta = F.log(y1 / F.greatest(t1 - y1, F.lit(1.0))) - F.log(y0 / F.greatest(t0 - y0, F.lit(1.0)))
    c = c.withColumns({"delta": delta, "z": delta / F.sqrt(1 / y1 + 1 / y0)})
    c = c.where((F.abs("z") >= MIN_Z) & (F.col("safe") + F.col("unsafe") + F.col("seed") >= MIN_COUNT - 1))
    found = c.select("term", "delta", F.abs("z").alias("z")).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} terms with evidence")
    return {r[0]: max(-CLIP, min(CLIP, r[1])) for r in sorted(found, key=lambda r: (-r[2], r[0]))}


def harmful_terms(lexicon: DataFrame, limit: int = MAX_LEXICON) -> list[str]:
    """Words and pairs of the coded terms with a harmful meaning; the table is small by nature, its size is checked."""
    rows = lexicon.where(F.col("meaning").rlike(HARMFUL)).select("term").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lexicon of more than {limit} harmful terms")
    return [t for r in rows if r[0] for t in terms_of(r[0]) if " " in t and START not in t or " " not in r[0] and t == r[0].lower()]


class Scorer:
    def __init__(self, odds: dict[str, float]):
        self.ids: dict[str, int] = {START: 0}
        self.word: dict[int, float] = {}
        self.pair: dict[int, float] = {}
        for term, d in odds.items():
            parts = [self.ids.setdefault(p, len(self.ids)) for p in term.split(" ")]
            if len(parts) == 1:
                self.word[parts[0]] = d
            else:
                self.pair[parts[0] << 32 | parts[1]] = d
        marked = [w for w in self.ids if w.isalpha() and len(w) > 3 and self.word.get(self.ids[w], 0) > 1.0]
        self.close: dict[str, str] = {}
        for w in sorted(marked, reverse=True):
            for i in range(len(w)):
                self.close[w[:i] + "?" + w[i + 1 :]] = w
                if len(w) > 4:
                    self.close[w[:i] + w[i + 1 :]] = w
            self.close[self._squeeze(w)] = w
        self.memo: dict[str, int] = {}

    @staticmethod
    def _squeeze(w: str) -> str:
        return "~" + re.sub(r"(.)\1+", r"\1", w)

    def _id(self, token: str) -> int:
        w = fold(token)
        i = self.ids.get(w, -1)
        if i < 0 and len(w) > 2:
            near = self.close.get(w) or self.close.get(self._squeeze(w))
            if near is None and "?" in w:
                near = self.close.get(w.replace("?", ""))
            i = self.ids[near] if near else -1
        if len(self.memo) < 500_000:
            self.memo[token] = i
        return i

    def scores(self, text: str) -> list[float]:
        memo, word, pair = self.memo, self.word, self.pair
        out, last = [], 0
        for t in tokens_of(text):
            i = memo.get(t)
            if i is None:
                i = self._id(t)
            if i < 0:
                out.append(UNKNOWN)
            else:
                d = pair.get(last << 32 | i) if last >= 0 else None
                if d is None:
                    d = 0.7 * word.get(i, 0.0)
                out.append(d - DRIFT)
            last = i
        return out


def best_segment(s: list[float]) -> float:
    best = run = 0.0
    for x in s:
        run = run + x if run > 0 else x
        if run > best:
            best = run
    return best


def maximal_segments(s: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint, in one pass over the scores.

    Each kept segment links to the nearest one before it whose total before is
    smaller, so no segment is passed over twice.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total through, link
    total = 0.0
    for i, x in enumerate(s):
        if x <= 0:
            total += x
            continue
        a, b, lo, hi = i, i + 1, total, total + x
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= lo:
                j = found[j][4]
            if j < 0 or found[j][3] >= hi:
                found.append((a, b, lo, hi, j))
                break
            a, lo = found[j][0], found[j][2]
            del found[j:]
            j -= 1
        total += x
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


class Calibration:
    """Extreme-value law of the best segment of background tokens, from a histogram of their scores."""

    def __init__(self, hist: dict[float, int], texts: int, tokens: int, tail: list[tuple[float, int]]):
        self.scale, self.k = 1.0, 0.1
        n = sum(hist.values())
        if n:
            x, p = np.array(list(hist)), np.array(list(hist.values())) / n
            if x.max() > 0 and (x * p).sum() < 0:
                lo, hi = 1e-6, 20.0
                for _ in range(80):
                    mid = (lo + hi) / 2
                    lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * x, 50))).sum() > 1 else (mid, hi)
                self.scale = max(lo, 1e-3)
        # K from the share of texts whose best segment passes a moderate score
        rates = [-math.log(max(1 - c / texts, 1e-9)) / (tokens / texts) * math.exp(self.scale * s) for s, c in tail if texts and 0 < c < texts and tokens]
        if rates:
            self.k = float(np.median(rates))

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.scale * score)) if score > 0 else 1.0

    def together(self, scores: list[float], n: int) -> tuple[float, int]:
        """(probability, r) of the most significant r best segments of n background tokens; choosing r costs a factor 2**r."""
        best, most, total, room = 1.0, 0, 0.0, math.log(self.k * max(n, 1))
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            x = self.scale * score - room
            if r > 1 and x <= math.log(2):
                break  # neither this segment nor a lesser one can make the sum more significant
            total += x
            p = self.p_value(score, n) if r == 1 else math.exp((r - 1) * math.log(max(total, 1e-9)) - total - math.lgamma(r + 1) - math.lgamma(r)) if total > 1 else 1.0
            if (p := min(1.0, p * 2.0**r)) < best:
                best, most = p, r
        return best, most


def background(labelled: DataFrame, scorer: Scorer, trim: float) -> Calibration:
    """Calibration over all rows labelled safe whose best segment stays below ``trim`` (the others are mislabelled)."""
    shared = labelled.sparkSession.sparkContext.broadcast(scorer)
    marks = [0.5, 1.0, 1.5, 2.0, 3.0]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                s = shared.value.scores(text)
                best = best_segment(s)
                if best < trim:
                    c[("texts", 0.0)] += 1
                    c[("tokens", 0.0)] += len(s)
                    c.update(("token", round(x, 1)) for x in s)
                    c.update(("best", m) for m in marks if best >= m)
        keys = list(c)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.float64()), pa.array([c[k] for k in keys], pa.int64())], ["kind", "x", "n"])

    safe = labelled.where("text IS NOT NULL AND lower(trim(class)) = 'safe'").select("text")
    rows = safe.mapInArrow(op, "kind string, x double, n bigint").groupBy("kind", "x").agg(F.sum("n").alias("n")).collect()
    by = {k: {r[1]: r[2] for r in rows if r[0] == k} for k in ("token", "texts", "tokens", "best")}
    return Calibration(by["token"], by["texts"].get(0.0, 0), by["tokens"].get(0.0, 0), sorted(by["best"].items()))


class Model:
    """Scores and calibration, fitted on labelled rows (text, class) and a lexicon (term, meaning)."""

    def __init__(self, labelled: DataFrame, lexicon: DataFrame | None = None, trim: float = 5.0):
        terms = [] if lexicon is None else harmful_terms(lexicon)
        self.scorer = Scorer(log_odds(term_counts(labelled), terms))
        self.law = background(labelled, self.scorer, trim)

    def judge(self, text: str | None) -> tuple[float, float, list[tuple[int, int]]]:
        """(score, probability under the background, token spans of the segments that make it)."""
        s = self.scorer.scores(text) if text else []
        segments = maximal_segments(s)
        p, r = self.law.together([x for _, _, x in segments], len(s))
        top = sorted(segments, key=lambda x: (-x[2], x[0]))[:r]
        return sum(x for _, _, x in top), p, sorted((a, b) for a, b, _ in top)

    def passages(self, text: str) -> list[str]:
        """The passages that make a text toxic, in order; none if it is not."""
        _, p, spans = self.judge(text)
        t = tokens_of(text) if p <= ALPHA else []
        return [" ".join(t[a:b]) for a, b in spans] if t else []


def score(rows: DataFrame, model: Model, keys: list[str], passages: bool = False) -> DataFrame:
    """(keys..., score, p_value[, passages]) of every row (keys..., text)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.scorer, model.law))

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.scorer, m.law = shared.value
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            got = [m.judge(t) for t in texts]
            cols = [*(b.column(i) for i in range(len(keys))), pa.array([round(g[0], 4) for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())]
            names = [*keys, "score", "p_value"]
            if passages:
                cols.append(pa.array([m.passages(t) if t and g[1] <= ALPHA else [] for t, g in zip(texts, got)], pa.list_(pa.string())))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double, p_value double" + (", passages array<string>" if passages else "")
    return rows.select(*keys, "text").mapInArrow(op, schema)
