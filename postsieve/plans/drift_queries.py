"""Queries of the schema drift operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift
from ..session import spread, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_changes(spread(table(spark, sf, "label_lines").select("run_id", "file_seq", "line_no", "record_id", "raw"))).distinct()


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every label line in one table with the same columns; branches and the other fields as lines of text."""
    u = drift.unify(spread(table(spark, sf, "label_lines").select("run_id", "file_seq", "line_no", "record_id", "raw")))
    lined = lambda a, f: F.array_join(F.array_sort(F.transform(a, f)), "\n")
    branches = lined("branches", lambda b: F.concat_ws(":", b["column"], b["tag"], b["written"]))
    rest = lined(F.map_entries("rest"), lambda e: F.concat_ws(":", e["key"], e["value"]["tag"], F.coalesce(e["value"]["val"], F.lit("null"))))
    return u.withColumns({"branches": branches, "rest": rest})


def p1_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Types that a field takes, over all files, with lines and files of each."""
    a = drift.type_alternatives(drift.typed_lines(table(spark, sf, "label_lines")))
    return a.groupBy("field", "tag").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_files"))


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels, "p1_alternatives": p1_alternatives}

_FIELDS = """
lines AS (
  SELECT run_id, file_seq, record_id, CAST(raw AS JSON) AS j FROM label_lines
  WHERE CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' ELSE false END
), kv AS (
  SELECT run_id, file_seq, record_id, k AS field, j -> ('$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(j)) AS k FROM lines)
), f AS (
  SELECT run_id, file_seq, record_id, field,
    CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array'
      WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS tag,
    CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$'
      WHEN json_type(v) = 'OBJECT' THEN '{' || coalesce(list_aggregate(list_transform(list_sort(json_keys(v)), lambda k: CAST(to_json(k) AS VARCHAR) || ':' || CAST(v -> ('$."' || k || '"') AS VARCHAR)), 'string_agg', ','), '') || '}'
      WHEN json_type(v) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') OR regexp_matches(CAST(v AS VARCHAR), '[eE]') THEN CAST(v AS VARCHAR)
      WHEN contains(CAST(v AS VARCHAR), '.') THEN rtrim(rtrim(CAST(v AS VARCHAR), '0'), '.') ELSE CAST(v AS VARCHAR) END AS val
  FROM kv
)"""

_CHANGES = f"""{_FIELDS}, n AS (
  SELECT run_id, file_seq, count(*) AS n_lines FROM lines GROUP BY ALL
), files AS (
  SELECT run_id, file_seq, lag(file_seq) OVER (PARTITION BY run_id ORDER BY file_seq) AS prev_seq FROM n
), types AS (
  SELECT run_id, file_seq, field, sum(c) AS present, arg_min(tag, (-c, tag)) FILTER (tag <> 'null') AS kind
  FROM (SELECT run_id, file_seq, field, tag, count(*) AS c FROM f GROUP BY ALL) GROUP BY ALL
), has AS (
  SELECT t.run_id, t.file_seq, field, kind FROM types t JOIN n USING (run_id, file_seq) WHERE present * 10 >= n_lines
), gone AS (
  SELECT s.run_id, s.file_seq, s.prev_seq, h.field FROM files s JOIN has h ON h.run_id = s.run_id AND h.file_seq = s.prev_seq
  WHERE NOT EXISTS (SELECT 1 FROM has b WHERE b.run_id = s.run_id AND b.file_seq = s.file_seq AND b.field = h.field)
), fresh AS (
  SELECT s.run_id, s.file_seq, h.field FROM files s JOIN has h ON h.run_id = s.run_id AND h.file_seq = s.file_seq
  WHERE s.prev_seq IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM has b WHERE b.run_id = s.run_id AND b.file_seq = s.prev_seq AND b.field = h.field)
), txt AS (
  SELECT run_id, file_seq, record_id, val AS text FROM f WHERE field = 'text' AND tag = 'string'
), ren AS (
  SELECT g.run_id, g.file_seq, g.field AS old, w.field AS new
  FROM gone g JOIN fresh w ON g.run_id = w.run_id AND g.file_seq = w.file_seq
  JOIN f a ON a.run_id = g.run_id AND a.file_seq = g.prev_seq AND a.field = g.field
  JOIN txt ta ON ta.run_id = a.run_id AND ta.file_seq = a.file_seq AND ta.record_id = a.record_id
  JOIN f b ON b.run_id = g.run_id AND b.file_seq = g.file_seq AND b.field = w.field
  JOIN txt tb ON tb.run_id = b.run_id AND tb.file_seq = b.file_seq AND tb.record_id = b.record_id AND tb.text = ta.text
  GROUP BY ALL HAVING count(*) FILTER (a.tag = b.tag AND a.val = b.val) * 10 >= count(*) * 9
)"""

_TARGETS = ", ".join(f"('{c}', '{k}')" for c, k in drift.TARGET.items())
_VALUES = {
    "string": "CASE WHEN {c}.tag = 'array' THEN array_to_string(CAST(CAST({c}.val AS JSON) AS VARCHAR[]), ', ') ELSE {c}.val END",
    "double": "TRY_CAST({c}.val AS DOUBLE)",
    "boolean": "TRY_CAST({c}.val AS BOOLEAN)",
    "array<string>": "CASE WHEN {c}.tag = 'array' THEN CAST(CAST({c}.val AS JSON) AS VARCHAR[]) WHEN {c}.tag IS NOT NULL THEN [{c}.val] END",
}
_LABELS = f"""WITH RECURSIVE {_CHANGES}, target(field, kind) AS (VALUES {_TARGETS}
), lin AS (
  SELECT h.run_id, h.file_seq, h.field, printf('%09d:%s', h.file_seq, h.field) AS lineage FROM has h JOIN files s USING (run_id, file_seq)
  WHERE NOT EXISTS (SELECT 1 FROM has p WHERE p.run_id = h.run_id AND p.file_seq = s.prev_seq AND p.field = h.field)
    AND NOT EXISTS (SELECT 1 FROM ren r WHERE r.run_id = h.run_id AND r.file_seq = h.file_seq AND r.new = h.field)
  UNION
  SELECT h.run_id, h.file_seq, h.field, l.lineage FROM lin l JOIN files s ON s.run_id = l.run_id AND s.prev_seq = l.file_seq
  JOIN has h ON h.run_id = s.run_id AND h.file_seq = s.file_seq
  WHERE h.field = l.field OR EXISTS (SELECT 1 FROM ren r WHERE r.run_id = h.run_id AND r.file_seq = h.file_seq AND r.old = l.field AND r.new = h.field)
), part AS (
  SELECT run_id, file_seq, field, min(lineage) AS lineage FROM lin GROUP BY ALL
), vote AS (
  SELECT a.field, b.field AS col, count(DISTINCT (a.run_id, a.lineage)) AS n FROM part a JOIN part b ON a.run_id = b.run_id AND a.lineage = b.lineage
  WHERE a.field NOT IN (SELECT field FROM target) AND b.field IN (SELECT field FROM target) GROUP BY ALL
), voted AS (
  SELECT field, max_by(col, (n, col)) AS col, max(n) AS n FROM vote GROUP BY field
), best AS (
  SELECT run_id, lineage, coalesce(min(p.field) FILTER (p.field IN (SELECT field FROM target)), max_by(col, (n, col)) FILTER (col IS NOT NULL)) AS col
  FROM part p LEFT JOIN voted USING (field) GROUP BY run_id, lineage
), named AS (
  SELECT run_id, file_seq, col, min(field) AS field FROM part p JOIN best b USING (run_id, lineage)
  WHERE col IS NOT NULL AND field NOT IN (SELECT field FROM target) GROUP BY ALL
), own AS (
  SELECT record_id, field AS col, field, tag, val FROM f WHERE field IN (SELECT field FROM target)
), placed AS (
  SELECT * FROM own UNION ALL SELECT f.record_id, n.col, f.field, f.tag, f.val FROM f JOIN named n USING (run_id, file_seq, field)
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.record_id = f.record_id AND o.col = n.col)
), odd AS (
  SELECT record_id, string_agg(concat_ws(':', col, tag, val), chr(10) ORDER BY concat_ws(':', col, tag, val)) AS branches FROM placed JOIN target t ON t.field = col
  WHERE tag <> 'null' AND tag <> CASE kind WHEN 'double' THEN 'number' WHEN 'array<string>' THEN 'array' ELSE kind END GROUP BY record_id
), other AS (
  SELECT record_id, string_agg(concat_ws(':', field, tag, val), chr(10) ORDER BY concat_ws(':', field, tag, val)) AS rest FROM f
  WHERE field <> 'text' AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.record_id = f.record_id AND p.field = f.field) GROUP BY record_id
)
SELECT l.record_id, l.run_id, l.file_seq, x.line_no, t.text, {", ".join(f"{_VALUES[k].format(c=f'c{i}')} AS {c}" for i, (c, k) in enumerate(drift.TARGET.items()))},
  coalesce(odd.branches, '') AS branches, coalesce(other.rest, '') AS rest
FROM lines l JOIN label_lines x USING (record_id) LEFT JOIN txt t ON t.record_id = l.record_id
{" ".join(f"LEFT JOIN placed c{i} ON c{i}.record_id = l.record_id AND c{i}.col = '{c}' AND c{i}.tag <> 'null'" for i, c in enumerate(drift.TARGET))}
LEFT JOIN odd ON odd.record_id = l.record_id LEFT JOIN other ON other.record_id = l.record_id"""

ORACLES = {
    "p1_alternatives": f"""WITH {_FIELDS}
SELECT field, tag, count(*) AS n_values, count(DISTINCT (run_id, file_seq)) AS n_files FROM f GROUP BY ALL""",
    "p1_labels": _LABELS,
    "p1_found": f"""WITH {_CHANGES}
SELECT run_id, file_seq, 'renamed' AS change, old AS field, new AS new_field FROM ren
UNION ALL SELECT run_id, file_seq, 'removed', field, field FROM gone g
  WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.run_id = g.run_id AND r.file_seq = g.file_seq AND r.old = g.field)
UNION ALL SELECT run_id, file_seq, 'added', field, field FROM fresh g
  WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.run_id = g.run_id AND r.file_seq = g.file_seq AND r.new = g.field)
UNION ALL SELECT s.run_id, s.file_seq, 'retyped', b.field, b.field FROM files s
  JOIN has a ON a.run_id = s.run_id AND a.file_seq = s.prev_seq
  JOIN has b ON b.run_id = s.run_id AND b.file_seq = s.file_seq AND b.field = a.field WHERE a.kind <> b.kind""",
}
