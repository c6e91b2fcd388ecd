"""Matching of posts against moderation rules and a lexicon of coded terms.

Rules are foldable patterns over a JVM column. A lexicon is small by nature and
its size is checked: up to INLINE_TERMS terms become one array expression per
post, so that no post is moved; larger ones, up to MAX_TERMS, are broadcast and
matched by a nested-loop join on a substring probe before the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import bounded, has_word_char, longest_piece, normalised, probes, term_pattern, with_forms

INLINE_TERMS = 256
MAX_TERMS = 50_000
HIT = "struct<kind:string,category:string,token:string,meaning:string>"


def _hit(kind: str, category: str | Column, token: str | Column, meaning: str | Column | None) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(kind).alias("kind"), c(category).alias("category"), c(token).alias("token"), c(meaning).alias("meaning"))


def moderation_hits(norm: Column, probe: Column) -> Column:
    """Array of hits of a normalised text, one per pattern that occurs, in rule order.

    Literal probes in the folded text come before each pattern: a match folds to a text that holds one.
    """
    def occurs(pattern: str) -> Column:
        hit, words = norm.rlike(bounded(pattern)), probes(pattern)
        return hit if words is None else reduce(Column.__or__, [probe.contains(w) for w in words]) & hit

    return F.array_compact(F.array(*[F.when(occurs(p), _hit("moderation", c, p, None)) for c, ps in rules.MODERATION.items() for p in ps]))


def meaning_category(meaning: Column) -> Column:
    out = F
    for category, pattern in rules.MEANINGS.items():
        out = out.when(F.coalesce(meaning, F.lit("")).rlike(bounded(pattern)), category)
    return out.otherwise("benign")


@dataclass(frozen=True)
class Term:
    """A lexicon entry ready for matching: its rank in the output, probe, pattern (None for substring search) and meanings."""

    rank: int
    token: str
    probe: str
    pattern: str | None
    meanings: tuple[tuple[str, str], ...]


def load_lexicon(lexicon: DataFrame) -> list[Term]:
    """Terms of a table (term_ord, term, meaning); rows of one term are its meanings, in order.

    Empty and null meanings are dropped, and terms without one. Of two terms equal
    after normalisation the later gives the meanings of both; each is matched.
    """
    rows = (
        lexicon.where("term IS NOT NULL AND meaning IS NOT NULL AND meaning <> ''")
        .select("term_ord", "term", "meaning", meaning_category(F.col("meaning")).alias("category"))
        .orderBy("term_ord", "meaning")
        .limit(MAX_TERMS + 1)
        .collect()
    )
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a lexicon of more than {MAX_TERMS} entries")
    entries: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        entries.setdefault(r["term"], []).append((r["meaning"], r["category"]))
    meanings = {normalised(t): tuple(ms) for t, ms in entries.items()}
    symbols = [t for t in dict.fromkeys(map(normalised, entries)) if t and not has_word_char(t)]
    words = [t for t in map(normalised, entries) if has_word_char(t)]
    out = [Term(i, t, t, None, meanings[t]) for i, t in enumerate(symbols)]
    return out + [Term(len(out) + i, t, longest_piece(t.casefold()), term_pattern(t.casefold()), meanings[t]) for i, t in enumerate(words)]


def coded_hits_inline(terms: list[Term], norm: Column, folded: Column, probe: Column) -> Column:
    if not terms:
        return F.array().cast(f"array<{HIT}>")
    parts = []
    for t in terms:
        hits = F.array(*[_hit("coded", c, t.token, m) for m, c in t.meanings])
        occurs = norm.contains(t.probe) if t.pattern is None else probe.contains(t.probe) & folded.rlike(t.pattern)
        parts.append(F.when(occurs, hits))
    return F.flatten(F.array_compact(F.array(*parts)))


def coded_hits_joined(posts: DataFrame, key: str, terms: list[Term]) -> DataFrame:
    """(key, coded_hits) of the posts (key, norm, folded, probe) with at least one hit, by a broadcast nested-loop join."""
    rows = [(t.rank, k, t.token, t.probe, t.pattern, m, c) for t in terms for k, (m, c) in enumerate(t.meanings)]
    d = F.broadcast(posts.sparkSession.createDataFrame(rows, "rank int, k int, token string, probe string, pattern string, meaning string, category string"))
    occurs = F.when(d["pattern"].isNull(), posts["norm"].contains(d["probe"])).otherwise(
        posts["probe"].contains(d["probe"]) & F.rlike(posts["folded"], d["pattern"])
    )
    j = posts.join(d, occurs).select(key, F.struct("rank", "k", _hit("coded", F.col("category"), F.col("token"), F.col("meaning")).alias("hit")).alias("h"))
    # a post meets each term once, so its list is bounded by the lexicon
    return j.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("h")), lambda x: x["hit"]).alias("coded_hits"))


def match_posts(posts: DataFrame, key: str, lexicon: DataFrame, inline: int = INLINE_TERMS) -> DataFrame:
    """Adds moderation_hits and coded_hits to posts (key, text, ...); a null text has no hits."""
    terms, made = load_lexicon(lexicon), ["norm", "folded", "probe"]
    n = with_forms(posts)
    n = n.withColumn("moderation_hits", moderation_hits(F.col("norm"), F.col("probe")))
    if len(terms) <= inline:
        return n.withColumn("coded_hits", coded_hits_inline(terms, F.col("norm"), F.col("folded"), F.col("probe"))).drop(*made)
    hits = coded_hits_joined(n.select(key, *made), key, terms)
    return n.drop(*made).join(hits, key, "left").withColumn("coded_hits", F.coalesce("coded_hits", F.array().cast(f"array<{HIT}>")))


def _capped_rows(lexicon: DataFrame) -> list:
    rows = lexicon.where("term <> ''").select("term_ord", "term", F.coalesce("meaning", F.lit("")).alias("meaning")).orderBy("term_ord").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a lexicon of more than {MAX_TERMS} entries")
    return rows


def with_capped_hits(posts: DataFrame, lexicon: DataFrame, max_hits: int = 8, inline: int = INLINE_TERMS) -> DataFrame:
    """Adds ``hits`` to posts (text, ...): array of (token, meaning) of the first ``max_hits`` terms of a lexicon that occur as substrings, in its order; null meanings become ''."""
    rows = _capped_rows(lexicon)
    none = F.array().cast("array<struct<token:string,meaning:string>>")
    if len(rows) <= inline:
        found = [F.when(F.col("text").contains(r["term"]), F.struct(F.lit(r["term"]).alias("token"), F.lit(r["meaning"]).alias("meaning"))) for r in rows]
        return posts.withColumn("hits", F.slice(F.array_compact(F.array(*found)), 1, max_hits) if found else none)
    d = F.broadcast(posts.sparkSession.createDataFrame([(i, r["term"], r["meaning"]) for i, r in enumerate(rows)], "k int, token string, meaning string"))
    texts = posts.where("text IS NOT NULL").select("text", F.unhex(F.md5("text")).alias("_key")).dropDuplicates(["_key"])
    j = texts.join(d, texts["text"].contains(d["token"])).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("k", "token", "meaning"))).alias("h"))
    top = j.select("_key", F.transform(F.slice("h", 1, max_hits), lambda x: F.struct(x["token"].alias("token"), x["meaning"].alias("meaning"))).alias("hits"))
    return posts.withColumn("_key", F.unhex(F.md5("text"))).join(top, "_key", "left").withColumn("hits", F.coalesce("hits", none)).drop("_key")
