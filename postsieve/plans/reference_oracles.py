"""SQL equivalents of the reference queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions import rules
from ..functions.language import FUNCTION_WORDS

_W = r"\p{L}\p{N}_"
_S = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"
_STRIP = rf"^{_S}+|{_S}+$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _bounded(pattern: str) -> str:
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"[\s\-]", r"[\s\p{Z}\-]").replace(r"\s", _S).replace(rf"[{_S}\p{{Z}}\-]", rf"(?:{_S}|-)")
    return rf"(?i)(?:^|[^{_W}]){inner}(?:$|[^{_W}])"


# the characters of the tables that compatibility normalisation changes
_NORM = "replace(replace(replace(replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8201), ' '), chr(12288), ' '), chr(8230), '...'), chr(65039), ''), chr(65038), '')"
_RULES = " UNION ALL ".join(
    f"SELECT row_id, {i} AS ord, {_q(c)} AS category, {_q(p)} AS token FROM n WHERE regexp_matches(norm, {_q(_bounded(p))})" for i, (c, p) in enumerate((c, p) for c, ps in rules.MODERATION.items() for p in ps)
)
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(meaning, ''), {_q(_bounded(p))}) THEN {_q(c)}" for c, p in rules.MEANINGS.items()) + " ELSE 'benign' END"
_GAP = rf"[\s\p{{Z}}\x{{0b}}\x{{85}}\x{{1c}}-\x{{1f}}_\-]*"
_SEVERITY = " ".join(f"WHEN list_contains(CATS, {_q(c)}) THEN {_q(c)}" for c in rules.SEVERITY)

_HITS = rf"""
n AS (SELECT row_id, {_NORM} AS norm FROM combined),
mh AS ({_RULES}),
lex AS (
  SELECT term_ord, term, meaning, {_CATEGORY} AS category, regexp_matches(term, '[\p{{L}}\p{{N}}]') AS wordish,
    list_aggregate(list_transform(string_split(replace(lower(term), '-', ' '), ' '), lambda x: strlen(x)), 'max') AS size, string_split(replace(lower(term), '-', ' '), ' ') AS pieces,
    '(?i)(?:^|[^{_W}])' || replace(replace(regexp_escape(lower(term)), '\-', '{_GAP}'), '\ ', '{_GAP}') || '(?:$|[^{_W}])' AS pattern
  FROM lexicon WHERE meaning IS NOT NULL AND meaning <> ''
),
ch AS (
  SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY wordish, term_ord) AS ord, category, term AS token, meaning
  FROM (SELECT *, lower(norm) AS low FROM n) JOIN lex
  ON CASE WHEN NOT wordish THEN contains(norm, term) WHEN contains(low, list_filter(pieces, lambda x: strlen(x) = size)[1]) THEN regexp_matches(low, pattern) ELSE false END
)"""
_LABELS = rf"""WITH {_HITS},
m AS (SELECT row_id, list(DISTINCT category) AS cats, string_agg(category || ':' || token, ';' ORDER BY ord) AS txt FROM mh GROUP BY row_id),
c AS (SELECT row_id, list(DISTINCT category) AS cats, string_agg(category || ':' || token || ':' || meaning, ';' ORDER BY ord) AS txt FROM ch GROUP BY row_id),
j AS (
  SELECT n.row_id, coalesce(m.cats, []) AS mc, coalesce(c.cats, []) AS cc, list_filter(coalesce(c.cats, []), lambda x: x <> 'benign') AS harm,
    coalesce(m.txt, '') AS moderation, coalesce(c.txt, '') AS coded
  FROM n LEFT JOIN m USING (row_id) LEFT JOIN c USING (row_id)
),
d AS (
  SELECT *, CASE WHEN list_has_any(mc, {rules.MODERATED}) THEN 1 WHEN len(harm) > 0 THEN 2 WHEN list_contains(mc, 'harassment') THEN 3
    WHEN list_contains(mc, 'spam') THEN 4 WHEN list_contains(cc, 'benign') THEN 5 ELSE 6 END AS k FROM j
),
labelled AS (
  SELECT row_id, CASE k WHEN 1 THEN 'moderated' WHEN 5 THEN 'clean' WHEN 6 THEN 'clean' ELSE 'questionable' END AS label,
    CASE k WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.75 WHEN 4 THEN 0.6 WHEN 5 THEN 0.55 ELSE 0.9 END::DOUBLE AS confidence,
    CASE k WHEN 1 THEN 'moderation-hit:' || CASE {_SEVERITY.replace('CATS', 'mc')} END
      WHEN 2 THEN 'coded-harmful:' || CASE {_SEVERITY.replace('CATS', 'harm')} ELSE 'coded' END
      WHEN 3 THEN 'moderation-hit:harassment' WHEN 4 THEN 'moderation-hit:spam' WHEN 5 THEN 'coded-benign' ELSE 'no-hits' END AS reasons,
    moderation, coded FROM d
)"""

_T = rf"regexp_replace(coalesce(text, ''), '{_STRIP}', '', 'g')"
_GARBAGE = rf"""
g AS (SELECT row_id, {_T} AS t FROM combined),
r AS (
  SELECT row_id, CASE
    WHEN t = '' THEN 'empty'
    WHEN regexp_full_match(t, '(?i)\s*https?://[^\s\p{{Z}}]+\s*') THEN 'address'
    WHEN regexp_matches(t, '(?i)\.(com|org|net|io|co|uk|tv|info|edu|gov)') AND NOT contains(t, 'http://') AND NOT contains(t, 'https://')
      AND (length(t) - length(regexp_replace(t, '[.:/@\-]', '', 'g'))) / length(t) > 0.4 THEN 'broken_address'
    WHEN regexp_full_match(t, '@[{_W}]+') THEN 'handle'
    WHEN length(t) >= 5 AND replace(t, t[1], '') = '' THEN 'repeated'
    WHEN regexp_full_match(regexp_replace(t, '[ _\-]', '', 'g'), '\p{{Nd}}+') THEN 'digits'
    WHEN length(t) > 2 AND (length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}\s\p{{Z}}\x{{1c}}-\x{{1f}}]', '', 'g'))) / length(t) > 0.7 AND NOT regexp_matches(t, '\p{{So}}') THEN 'symbols'
    WHEN regexp_matches(t, '\p{{So}}') THEN NULL
    WHEN length(t) < 4 THEN 'short' END AS rule FROM g
)"""

_LOOSE = rf"lower(regexp_replace(coalesce(text, 'None'), '{_STRIP}', '', 'g'))"
_CROSS = """x AS (
  SELECT data, count(*) FILTER (class = 'safe') AS safe, count(*) FILTER (class = 'unsafe') AS unsafe, count(*) AS total
  FROM hatebase_cleaned WHERE data IS NOT NULL AND class IS NOT NULL GROUP BY data
)"""
_PCT = "round_even({0} * 100.0::DOUBLE / total, 1) AS {0}_pct"
_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM combined" for c in "row_id text data src_id author_id lang posted_at ingested_at".split())
_LIST = "coalesce(array_to_string({0}, ', '), '') AS {0}"
_FIELD = "coalesce(CAST({0} AS VARCHAR), '') AS {0}"
_CSV = ", ".join(_LIST.format(c) if c in ("spans", "decoded") else _FIELD.format(c) for c in (*rules.EXPORT_COLUMNS, "file_seq", "line_no", "reason", "record_id", "run_id"))
_EXTRACT = """e AS (
  SELECT record_id AS line, coalesce(text, '') AS text, is_coded, coalesce(confidence, 0.0) AS confidence, coalesce(domain, '') AS domain, coalesce(mechanism, '') AS mechanism,
    coalesce(reasoning, '') AS reasoning, coalesce(spans, []) AS spans, coalesce(decoded, []) AS decoded, coalesce(needs_review, false) AS needs_review
  FROM llm_labeled_posts WHERE is_coded IN ('yes', 'unsure')
)"""
_QUOTED = "'[' || coalesce(array_to_string(list_transform({0}, lambda x: '''' || x || ''''), ', '), '') || ']'"

_LANGS = ", ".join(f"('{k}', '{w}')" for k, ws in FUNCTION_WORDS.items() for w in ws.split())
_CAPPED = """WITH h AS (
  SELECT row_id, term, coalesce(meaning, '') AS meaning, term_ord, row_number() OVER (PARTITION BY row_id ORDER BY term_ord) AS k
  FROM combined JOIN lexicon ON contains(text, term) WHERE term <> ''
) SELECT row_id, string_agg(term || '=' || meaning, ';' ORDER BY term_ord) AS hits FROM h WHERE k <= 2 GROUP BY row_id"""
_BLOCKS = f"""blocks AS (
  SELECT 0 AS post_no, 'Found ' || count(*) || ' coded posts (yes/unsure):' || chr(10) AS block FROM e
  UNION ALL SELECT n, '--- Post ' || n || ' ---' || chr(10) || 'Text: ' || text || chr(10) || 'Label: ' || is_coded || ' (confidence: ' || confidence || ')' || chr(10) || 'Domain: ' || domain || chr(10)
  || 'Mechanism: ' || mechanism || chr(10) || 'Spans: ' || {_QUOTED.format('spans')} || chr(10) || 'Decoded: ' || {_QUOTED.format('decoded')} || chr(10)
  || 'Needs Review: ' || CASE WHEN needs_review THEN 'True' ELSE 'False' END || chr(10) || 'Reasoning: ' || reasoning || chr(10) FROM (SELECT *, row_number() OVER (ORDER BY line) AS n FROM e)
)"""
# what the stub model answers, by the length of a post
_STUB = """n AS (SELECT text, length(text) AS n FROM POSTS),
a AS (
  SELECT text, n, n % 97 = 0 AS bad, n % 89 = 0 AS empty, CASE n % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END AS answer,
    CASE WHEN n % 11 = 0 THEN 'text 400' ELSE 'structured 400' END AS reason FROM n
)"""

ORACLES: dict[str, str] = {
    "rule_labels": f"{_LABELS} SELECT * FROM labelled",
    "rule_label_counts": f"{_LABELS} SELECT count(*) FILTER (label = 'clean') AS clean, count(*) FILTER (label = 'questionable') AS questionable, count(*) FILTER (label = 'moderated') AS moderated FROM labelled",
    "moderation_hits_by_category": f"WITH {_HITS} SELECT category, token, count(*) AS n FROM mh GROUP BY ALL",
    "lexicon_hits": f"WITH {_HITS} SELECT row_id, category, token, meaning FROM ch",
    "lexicon_hits_joined": f"WITH {_HITS} SELECT row_id, category, token, meaning FROM ch",
    "lexicon_hits_capped": _CAPPED,
    "meaning_categories": f"SELECT term_ord, term, {_CATEGORY} AS category FROM lexicon",
    "garbage_filter": f"WITH {_GARBAGE} SELECT row_id, rule FROM r WHERE rule IS NOT NULL",
    "garbage_counts": f"WITH {_GARBAGE} SELECT count(*) AS n_input, count(*) FILTER (rule IS NULL) AS n_kept FROM r",
    "dedupe_keep_first": f"SELECT row_id, text FROM (SELECT row_id, text, row_number() OVER (PARTITION BY {_LOOSE} ORDER BY row_id) AS k FROM combined) WHERE k = 1",
    "duplicate_groups": f"SELECT row_id FROM (SELECT row_id, count(*) OVER (PARTITION BY {_LOOSE}) AS n FROM combined) WHERE n > 1",
    "duplicate_count": f"SELECT count(*) - count(DISTINCT {_LOOSE}) AS excess_rows FROM combined",
    "null_profile": _NULLS,
    "table_shape": "SELECT count(*) AS n_rows, 4 AS n_columns FROM hatebase_cleaned",
    "class_distribution": "SELECT class, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM hatebase_cleaned WHERE class IS NOT NULL GROUP BY class",
    "source_class_crosstab": f"WITH {_CROSS} SELECT *, {_PCT.format('safe')}, {_PCT.format('unsafe')}, 100.0::DOUBLE AS total_pct FROM x",
    "source_class_pivot": f"WITH {_CROSS} SELECT data, safe, unsafe FROM x",
    "source_class_long": f"WITH {_CROSS} SELECT data, 'safe' AS class, safe AS n FROM x UNION ALL SELECT data, 'unsafe', unsafe FROM x",
    "source_class_joined": f"WITH {_CROSS} SELECT data, safe, unsafe, total, {_PCT.format('safe')}, {_PCT.format('unsafe')} FROM x",
    "before_after_histogram": f"""WITH a AS (SELECT label, row_number() OVER (PARTITION BY {_LOOSE} ORDER BY post_id) AS k FROM labeled_posts)
SELECT 'Before' AS version, label, count(*) AS n FROM a WHERE label IS NOT NULL GROUP BY label
UNION ALL SELECT 'After', label, count(*) FROM a WHERE k = 1 AND label IS NOT NULL GROUP BY label""",
    "keyword_search": "SELECT tweet_id, tweet, class, data FROM hatebase_cleaned WHERE regexp_matches(tweet, '(?i)lighthouse|velk')",
    "keyword_search_top": "SELECT tweet_id, class, data FROM hatebase_cleaned WHERE contains(lower(tweet), 'next to the gym') ORDER BY tweet_id LIMIT 100",
    "first_rows": "SELECT tweet_id, tweet, class, data FROM hatebase_cleaned ORDER BY tweet_id LIMIT 5",
    "distinct_sources": "SELECT DISTINCT data FROM hatebase_cleaned WHERE data IS NOT NULL",
    "tagged_union": "SELECT tweet AS text, 'hatebase' AS data FROM hatebase_cleaned UNION ALL SELECT text, 'bluesky' FROM labeled_posts",
    "resume_pending": """WITH p AS (SELECT post_id, sha1(text) AS hash, row_number() OVER (PARTITION BY text ORDER BY post_id) AS k FROM labeled_posts WHERE text IS NOT NULL)
SELECT post_id, hash FROM p WHERE k = 1 AND hash NOT IN (SELECT hash FROM llm_labeled_posts WHERE hash <> '' AND is_coded IN ('yes', 'no', 'unsure'))""",
    "content_hashes": "SELECT row_id, sha1(text) AS hash FROM combined",
    "coded_only": "SELECT post_id, label, len(coded_hits)::INTEGER AS n_hits FROM labeled_posts WHERE len(coded_hits) > 0",
    "review_buckets": """WITH a AS (
  SELECT record_id, is_coded, CASE WHEN is_coded = 'no' THEN 'none' ELSE domain END AS domain, CASE WHEN is_coded = 'no' THEN 'other' ELSE mechanism END AS mechanism,
    CASE WHEN is_coded = 'no' THEN 0 ELSE len(decoded) END AS n_decoded, is_coded = 'unsure' OR confidence < 0.65 AS needs_review
  FROM llm_labeled_posts WHERE is_coded <> 'error'
) SELECT record_id, domain, mechanism, n_decoded, needs_review,
  CASE WHEN needs_review THEN 'review' WHEN is_coded = 'yes' THEN 'yes' WHEN is_coded = 'no' THEN 'no' ELSE 'review' END AS bucket FROM a""",
    "run_counters": """WITH b AS (
  SELECT coalesce(is_coded = 'error', false) AS bad, CASE WHEN coalesce(needs_review, false) THEN 'review' WHEN is_coded = 'yes' THEN 'yes' WHEN is_coded = 'no' THEN 'no' ELSE 'review' END AS bucket
  FROM llm_labeled_posts
) SELECT count(*) FILTER (NOT bad) AS processed, count(*) FILTER (NOT bad AND bucket = 'yes') AS yes, count(*) FILTER (NOT bad AND bucket = 'no') AS clean,
  count(*) FILTER (NOT bad AND bucket = 'review') AS review, count(*) FILTER (bad) AS errors FROM b""",
    "csv_projection": f"SELECT {_CSV} FROM llm_labeled_posts",
    "extracted_posts": f"WITH {_EXTRACT} SELECT * REPLACE (coalesce(array_to_string(spans, ', '), '') AS spans, coalesce(array_to_string(decoded, ', '), '') AS decoded) FROM e",
    "extracted_report": f"WITH {_EXTRACT}, {_BLOCKS} SELECT * FROM blocks",
    "line_parsing": "SELECT run_id, count(*) FILTER (json_valid(raw)) AS n_parsed, count(*) FILTER (NOT coalesce(json_valid(raw), false)) AS n_bad FROM label_lines GROUP BY run_id",
    "record_keys": "SELECT DISTINCT unnest(json_keys(CASE WHEN json_valid(raw) THEN raw END)) AS key FROM label_lines",
    "lexicon_hits_capped_joined": _CAPPED,
    "english_posts": rf"""WITH l(lang, word) AS (VALUES {_LANGS}), t AS (SELECT row_id, replace(text, chr(10), ' ') AS text, lower(replace(text, chr(10), ' ')) AS low FROM combined WHERE text <> ''),
w AS (SELECT row_id, unnest(regexp_extract_all(low, '\p{{L}}+')) AS word FROM t), v AS (SELECT row_id, lang, count(*) AS n FROM w JOIN l USING (word) GROUP BY ALL),
r AS (SELECT row_id, lang, n = max(n) OVER (PARTITION BY row_id) AS best FROM v), b AS (SELECT row_id FROM r WHERE best GROUP BY row_id HAVING count(*) = 1 AND min(lang) = 'en')
SELECT text FROM t JOIN b USING (row_id)""",
    "model_labels": f"""WITH {_GARBAGE}, kept AS (SELECT text FROM combined JOIN r USING (row_id) WHERE rule IS NULL), {_STUB.replace('POSTS', 'kept')}
SELECT CASE WHEN NOT bad THEN sha1(text) END AS hash, text, CASE WHEN bad THEN 'error' ELSE answer END AS is_coded, CASE WHEN bad THEN NULL WHEN answer = 'no' THEN 'none' ELSE 'hate' END AS domain,
  CASE WHEN bad THEN NULL WHEN answer = 'no' THEN 'other' ELSE 'masking' END AS mechanism, CASE WHEN bad THEN 0.0 ELSE (n % 10) / 10.0 END::DOUBLE AS confidence, CASE WHEN NOT bad THEN '' END AS spans,
  CASE WHEN bad THEN NULL WHEN answer = 'no' THEN '' ELSE 'x' END AS decoded, CASE WHEN bad THEN 'LLM labeling failed: no JSON object. Raw output: ' || chr(39) || 'broken {{' || chr(39) ELSE reason END AS reasoning,
  'primary' AS model_used, CASE WHEN bad THEN NULL WHEN empty THEN 'second' ELSE 'primary' END AS model_actual, bad OR answer = 'unsure' OR n % 10 < 6.5 AS needs_review,
  CASE WHEN bad THEN NULL WHEN answer = 'unsure' OR n % 10 < 6.5 THEN 'review' ELSE answer END AS bucket FROM a""",
    "model_labels_per_copy": f"""WITH p AS (SELECT text, count(*) AS copies FROM labeled_posts WHERE text <> '' GROUP BY text), {_STUB.replace('POSTS', 'p')}
SELECT CASE WHEN bad THEN 'error' ELSE answer END AS is_coded, sum(CASE WHEN bad THEN copies ELSE 1 END)::BIGINT AS n_records, count(*) AS n_texts FROM a JOIN p USING (text) GROUP BY 1""",
    "model_prompts": f"""SELECT row_id, text AS post, '{",".join(rules.DOMAINS)}' AS domains, least(8, (SELECT count(*) FROM lexicon WHERE term <> '' AND contains(text, term)))::INTEGER AS n_hits, true AS instructed FROM combined""",
    "sample_size": "SELECT least(20, count(*)) AS n_rows, least(20, count(*)) AS n_distinct FROM hatebase_cleaned WHERE class = 'unsafe'",
    "screened_top": f"WITH {_GARBAGE} SELECT row_id, text FROM combined JOIN r USING (row_id) WHERE rule IS NULL ORDER BY row_id LIMIT 50",
    "nested_events": "SELECT replace(text, chr(10), ' ') AS text FROM combined WHERE lower(trim(data)) = 'bluesky' AND text <> ''",
}
