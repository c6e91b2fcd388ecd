"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table, where_computed
from . import dupes, encode, language, lookalike, mixture, nearup, pii, quality, toxic


def tweets_and_posts(spark: SparkSession, sf: str) -> DataFrame:
    """(tab, id, text) of both text tables."""
    a = table(spark, sf, "combined").select(F.lit("combined").alias("tab"), F.col("row_id").alias("id"), "text")
    b = table(spark, sf, "hatebase_cleaned").select(F.lit("hatebase_cleaned").alias("tab"), F.col("tweet_id").alias("id"), F.col("tweet").alias("text"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.copies(tweets_and_posts(spark, sf))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dupes.group_sizes(p2_found(spark, sf))


def p2_contents(spark: SparkSession, sf: str) -> DataFrame:
    """One record per content of each table with its number of copies, single ones included."""
    return dupes.contents(tweets_and_posts(spark, sf))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "combined").select(F.col("row_id").alias("id"), "text"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearup.near_pairs(posts(spark, sf), dupes.canonical)


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every post with the id of its group."""
    return nearup.near_groups(posts(spark, sf))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "combined").select(F.col("row_id").alias("id"), "text", "lang"))
    return language.segments(rows, language.train(language.training_sample(rows)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.mislabelled(_segments(spark, sf)).select(F.col("id").alias("row_id"), "seg_no", F.col("language").alias("lang")).distinct()


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every post, with its confidence."""
    return _segments(spark, sf).withColumnsRenamed({"id": "row_id", "lang": "declared"})


def _toxicity(spark: SparkSession, sf: str) -> tuple[toxic.Model, DataFrame]:
    h = table(spark, sf, "hatebase_cleaned").select(F.lit("hatebase_cleaned").alias("tab"), F.col("tweet_id").alias("row_id"), F.col("tweet").alias("text"), "class", "data")
    c = table(spark, sf, "combined").select(F.lit("combined").alias("tab"), "row_id", "text", F.lit(None).cast("string").alias("class"), "data")
    return toxic.Model(spread(h.select("text", "class")), table(spark, sf, "lexicon")), spread(c.unionByName(h))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _toxicity(spark, sf)
    return toxic.score(rows, model, ["tab", "row_id"]).where(F.col("p_value") <= toxic.ALPHA).select("tab", "row_id")


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score, probability and significant passages of every text."""
    model, rows = _toxicity(spark, sf)
    return toxic.score(rows, model, ["tab", "row_id"], passages=True)


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and share of toxic texts per table and source."""
    model, rows = _toxicity(spark, sf)
    rows = rows.withColumn("source", F.lower(F.trim("data"))).where("text IS NOT NULL")
    s = toxic.score(rows, model, ["tab", "source"])
    n = s.groupBy("tab", "source").agg(F.count("*").alias("n_texts"), F.count_if(F.col("p_value") <= toxic.ALPHA).alias("n_toxic"))
    return n.withColumn("toxic_share", F.round(F.col("n_toxic") / F.col("n_texts"), 6))


@lru_cache(maxsize=1)
def pii_model() -> pii.Model:
    """The same for every input: trained once per process."""
    return pii.Model()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(posts(spark, sf), pii_model()).withColumnRenamed("id", "row_id")


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every post with its personal data replaced."""
    return pii.redacted(posts(spark, sf), pii_model()).withColumnRenamed("id", "row_id")


def _two_post_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return spread(table(spark, sf, "labeled_posts").select("post_id", "text")), spread(table(spark, sf, "llm_labeled_posts").select("record_id", "text"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_post_tables(spark, sf)
    return lookalike.same_look(a, "post_id", b, "record_id").distinct()


def p7_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical text of every row of both tables."""
    a, b = _two_post_tables(spark, sf)
    rows = a.select(F.lit("labeled_posts").alias("tab"), F.col("post_id").alias("id"), "text").unionByName(
        b.select(F.lit("llm_labeled_posts").alias("tab"), F.col("record_id").alias("id"), "text")
    )
    keyed = rows.select(F.struct("tab", "id").alias("at"), "text")
    return lookalike.normalise(keyed, "at", lookalike.vocabulary(rows.select("text"))).select("at.tab", "at.id", "text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_column(documents(spark, sf), "doc_id")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = mixture.sized_documents(documents(spark, sf))
    return mixture.mix(docs, table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every target source."""
    docs = mixture.sized_documents(documents(spark, sf))
    return mixture.shares(*mixture.mix(docs, table(spark, sf, "mix_targets")))


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    """All statistics, and the reasons of the rules that fail."""
    v = quality.verdicts(quality.statistics(documents(spark, sf)))
    return v.withColumn("reasons", F.array_join("reasons", ","))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    v = quality.verdicts(quality.statistics(documents(spark, sf)))
    return where_computed(v.select("doc_id", "rejected"), F.col("rejected")).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p2_contents": p2_contents,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_scores": p5_scores,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_texts": p7_texts,
    "p8_ids": p8_ids,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_stats": p10_stats,
}

# ---- SQL ------------------------------------------------------------------

# white space as the Unicode property has it, and the separators of files, groups, records and units
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_BARE = f"regexp_replace(translate(lower({{}}), '{_SPACES}', ''), '\\p{{{{P}}}}', '', 'g')"
_COPIES = rf"""
t AS (
  SELECT 'combined' AS tab, row_id AS id, text FROM combined
  UNION ALL SELECT 'hatebase_cleaned', tweet_id, tweet FROM hatebase_cleaned
), parts AS (
  SELECT tab, id, text, string_split(replace(text, '|', ';'), ';') AS ps FROM t WHERE translate(text, '{_SPACES}', '') <> ''
), k AS (
  SELECT tab, id, {_BARE.format("text")} AS plain,
    CASE WHEN len(ps) >= 3 AND len(list_filter(ps, lambda x: NOT contains(x, ':')
        OR NOT regexp_full_match(trim(string_split(x, ':')[1], '{_SPACES}'), '\p{{L}}+'))) = 0
      THEN list_aggregate(list_sort(list_transform(ps, lambda x: {_BARE.format("x")})), 'string_agg', chr(1)) END AS fields
  FROM parts
), g AS (
  SELECT tab, id, coalesce(fields, min(fields) OVER (PARTITION BY tab, plain), plain) AS key FROM k
), m AS (
  SELECT tab, id, min(id) OVER (PARTITION BY tab, key) AS first_id FROM g
)"""

_GRAMS = r"""w AS (
  SELECT row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM combined
), s AS (
  SELECT DISTINCT row_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM w WHERE len(ws) >= 20
), n AS (
  SELECT row_id, count(*) AS n FROM s GROUP BY row_id
), p AS (
  SELECT a.row_id AS a, b.row_id AS b, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.row_id < b.row_id GROUP BY ALL
), near AS (
  SELECT a, b FROM p JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE i * 10 >= 6 * (x.n + y.n - i)
)"""

# look-alikes, width forms and spaces one to one; ligatures, ignorables and composition around them
_MARKED = {}
for _c, _l in lookalike.LOOKALIKE.items():  # letters with a mark that have a code point of their own in both scripts
    for _m in map(chr, range(0x300, 0x370)):
        _x, _y = unicodedata.normalize("NFC", _c + _m), unicodedata.normalize("NFC", _l + _m)
        if len(_x) == len(_y) == 1:
            _MARKED[_x] = _y
_FROM = "".join(lookalike.LOOKALIKE) + "".join(_MARKED) + "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_TO = "".join(lookalike.LOOKALIKE.values()) + "".join(_MARKED.values()) + "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " " * 16
_LOOK = "nfc_normalize(text)"
for _ligature, _letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "ſt"), ("ﬆ", "st")):
    _LOOK = f"replace({_LOOK}, '{_ligature}', '{_letters}')"
_LOOK = rf"regexp_replace({_LOOK}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}\x{{034F}}]', '', 'g')"
_LOOK = f"nfc_normalize(translate({_LOOK}, '{_FROM}', '{_TO}'))"

_WORD = quality.WORD.replace("*+", "*").replace("'", "''")
_ENDED = quality.ENDED.replace("*+$", "*$").replace("'", "''")
_BLANK = "".join(c for c in _SPACES if not "\x1c" <= c <= "\x1f")
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in quality._ALL)
_SHARE = "round(({})::DOUBLE / nullif({}, 0), 4)"
_QUALITY = rf"""
t AS (SELECT doc_id, text, string_split_regex(text, '\r\n|\n|\r') AS cut, regexp_extract_all(lower(text), '{_WORD}') AS words,
  regexp_extract_all(text, '\p{{L}}+|\s+|[^\p{{L}}\s]+') AS runs FROM documents WHERE translate(text, '{_BLANK}', '') <> ''
), l AS (SELECT *, list_filter(cut, lambda x: translate(x, '{_BLANK}', '') <> '') AS lines FROM t
), m AS (
  SELECT doc_id, text, lines, length(text) AS chars, len(words) AS n, len(lines) AS n_lines, list_sum(list_transform(words, lambda w: length(w))) AS word_chars,
    len(list_filter(words, lambda w: w IN ({_COMMON}))) AS common, len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{{L}}'))) AS numeric,
    list_sum(list_transform(lines, lambda x: length(x))) AS line_chars, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*(?:[-–•*·‣◦+]|\d{{1,3}}[.)])\s'))) AS bullets,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x: regexp_matches(x, '{_ENDED}') AND len(regexp_extract_all(x, '{_WORD}')) >= 5), lambda x: length(x))), 0) AS sentences,
    len(list_filter(lines, lambda x: regexp_matches(x, '{_ENDED}'))) AS n_ended, length(text) - length(regexp_replace(text, '\p{{P}}+', '', 'g')) AS n_punctuation,
    length(text) - length(regexp_replace(text, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS n_others, len(regexp_extract_all(text, '\.\.\.')) + length(text) - length(replace(text, '…', '  ')) AS n_ellipses,
    list_transform(lines, lambda x: trim(x)) AS bare, length(text) - length(replace(text, '#', '')) AS hashes,
    coalesce(list_sum(list_transform(range(3, len(runs) + 1), lambda i: CASE WHEN runs[i] = runs[i - 2] AND regexp_matches(runs[i], '\p{{L}}') AND NOT regexp_matches(runs[i - 1], '\S') THEN length(runs[i]) + length(runs[i - 1]) ELSE 0 END)), 0) AS doubled,
    CASE WHEN contains(text, '://') OR contains(text, 'www.') THEN chars - length(regexp_replace(text, '(?i)\b(?:https?://|www\.)\S+', '', 'g')) ELSE 0 END AS linked FROM l
), q AS (
  SELECT doc_id, chars, n, n_lines, {_SHARE.format("word_chars", "n")} AS mean_length, {_SHARE.format("common", "n")} AS common, {_SHARE.format("numeric", "n")} AS numeric, {_SHARE.format("hashes", "n")} AS hashes,
    {_SHARE.format("bullets", "n_lines")} AS bullets, {_SHARE.format("sentences", "line_chars")} AS sentences, {_SHARE.format("doubled", "chars")} AS doubled, {_SHARE.format("linked", "chars")} AS linked,
    {_SHARE.format("n_ended", "n_lines")} AS ended, {_SHARE.format("n_punctuation", "chars")} AS punctuation, {_SHARE.format("n_others", "chars")} AS others, {_SHARE.format("n_ellipses", "n")} AS ellipses,
    1 - {_SHARE.format("len(list_distinct(bare))", "n_lines")} AS same_lines,
    1 - {_SHARE.format("list_sum(list_transform(list_distinct(bare), lambda x: length(x)))", "list_sum(list_transform(bare, lambda x: length(x)))")} AS same_chars FROM m
)"""

ORACLES: dict[str, str] = {
    "p10_found": f"""WITH {_QUALITY} SELECT DISTINCT doc_id FROM q WHERE (n >= 5 AND common < 0.3 AND sentences < 0.5) OR (n >= 5 AND mean_length < 3) OR mean_length > 10
  OR (hashes > CASE WHEN n >= 5 THEN 0.1 ELSE 0.5 END AND sentences < 0.5) OR (n_lines > 2 AND bullets > 0.9 AND sentences < 0.5) OR (n >= 5 AND 1 - numeric < 0.8 AND sentences < 0.5)
  OR (n_lines > 3 AND (same_lines > 0.3 OR same_chars > 0.2)) OR (n >= 10 AND doubled > 0.2) OR linked > 0.5 OR (n = 0 AND chars > 8)""",
    "p10_stats": f"""WITH {_QUALITY} SELECT d.doc_id, coalesce(q.chars, 0) AS n_chars, coalesce(n, 0) AS n_words, coalesce(n_lines, 0) AS n_lines, mean_length AS mean_word_length, hashes AS hash_ratio, ellipses AS ellipsis_ratio,
  punctuation AS punctuation_share, 1 - others AS letter_share, 1 - numeric AS letter_word_share, ended AS ended_line_share, sentences AS sentence_share, bullets AS bullet_share, common AS common_share, linked AS link_share,
  doubled AS doubled_share, same_lines AS repeated_line_share, same_chars AS repeated_char_share,
  concat_ws(',', CASE WHEN n >= 5 AND common < 0.3 AND sentences < 0.5 THEN 'stop_words' END, CASE WHEN n >= 5 AND mean_length < 3 OR mean_length > 10 THEN 'word_length' END,
    CASE WHEN hashes > CASE WHEN n >= 5 THEN 0.1 ELSE 0.5 END AND sentences < 0.5 THEN 'hashes' END, CASE WHEN n_lines > 2 AND bullets > 0.9 AND sentences < 0.5 THEN 'bullets' END,
    CASE WHEN n >= 5 AND 1 - numeric < 0.8 AND sentences < 0.5 THEN 'letter_words' END, CASE WHEN n_lines > 3 AND (same_lines > 0.3 OR same_chars > 0.2) THEN 'repeated_lines' END,
    CASE WHEN n >= 10 AND doubled > 0.2 THEN 'repeated_words' END, CASE WHEN linked > 0.5 THEN 'links' END, CASE WHEN n = 0 AND chars > 8 THEN 'no_words' END,
    CASE WHEN ellipses > 0.1 THEN 'ellipses' END, CASE WHEN ended < 0.12 THEN 'few_ended_lines' END, CASE WHEN n < 50 THEN 'few_words' END) AS reasons,
  coalesce(regexp_matches(reasons, 'stop_words|word_length|hashes|bullets|letter_words|repeated|links|no_words'), false) AS rejected
FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id""",
    "p7_found": f"""WITH a AS (SELECT post_id, text, {_LOOK} AS look FROM labeled_posts WHERE text <> ''),
b AS (SELECT record_id, text, {_LOOK} AS look FROM llm_labeled_posts WHERE text <> '')
SELECT DISTINCT post_id, record_id FROM a JOIN b ON a.look = b.look AND a.text <> b.text""",
    "p2_found": f"WITH {_COPIES} SELECT tab, first_id, id AS copy_id FROM m WHERE id <> first_id",
    "p3_found": f"""WITH {_COPIES}, {_GRAMS}
SELECT a AS row_id_a, b AS row_id_b FROM near JOIN g ga ON ga.tab = 'combined' AND ga.id = a JOIN g gb ON gb.tab = 'combined' AND gb.id = b WHERE ga.key <> gb.key""",
    "p3_classes": f"""WITH RECURSIVE {_GRAMS}, c AS (
  SELECT row_id, min(row_id) OVER (PARTITION BY grams) AS rep FROM (SELECT row_id, md5(string_agg(gram, '|' ORDER BY gram)) AS grams FROM s GROUP BY row_id)
), e AS (
  SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) JOIN c x ON x.row_id = a JOIN c y ON y.row_id = b WHERE x.rep <> y.rep
), reach AS (
  SELECT DISTINCT rep AS node, rep AS root FROM c UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node
), r AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT d.row_id AS id, coalesce(root, d.row_id) AS cls, (SELECT count(*) FROM e WHERE e.a = c.rep) AS n_links FROM combined d LEFT JOIN c USING (row_id) LEFT JOIN r ON r.node = c.rep""",
    "p2_groups": f"WITH {_COPIES} SELECT tab, first_id, count(*) AS n_rows FROM m GROUP BY ALL HAVING count(*) > 1",
    "p2_contents": f"WITH {_COPIES} SELECT tab, first_id, count(*) AS n_rows FROM m GROUP BY ALL",
}
