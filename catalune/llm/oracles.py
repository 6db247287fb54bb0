"""DuckDB SQL of the queries of this subpackage that SQL can express.

The others rest on hashes, models or tokenizers that SQL lacks; tests hold them
against brute force.
"""

from __future__ import annotations

#: ASCII letters and digits and all code points beyond ASCII
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: what Python's str.split() parts words at
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark
), test AS (
  SELECT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM test) WHERE len(w) >= size)
), hit AS (
  SELECT DISTINCT doc_id, item, p.size, i FROM place p JOIN test t ON p.win = t.win AND p.size = t.size
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, size, i FROM hit)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

# Similar sets share a token among the rarest n - ceil(0.8 n) + 1 of each; pairs of classes that do are compared in full.
OP8 = f"""
WITH line AS (
  SELECT doc_id, i, x, list_sort(list_distinct(list_filter(string_split_regex(lower(x), '{_SPACE}'), lambda t: t <> ''))) AS w
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i, parts[i + 1] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), kind AS (
  SELECT w, row_number() OVER (ORDER BY doc_id, i) AS place FROM line WHERE len(w) > 0
), first AS (
  SELECT w, min(place) AS place FROM kind GROUP BY w
), token AS (
  SELECT place, len(w) AS n, unnest(w) AS t FROM first
), rare AS (
  SELECT t, row_number() OVER (ORDER BY count(*), t) AS r FROM token GROUP BY t
), prefix AS (
  SELECT place, n, t FROM (SELECT place, n, t, row_number() OVER (PARTITION BY place ORDER BY r) AS k FROM token JOIN rare USING (t)) WHERE k <= n - (4 * n + 4) // 5 + 1
), pair AS (
  SELECT DISTINCT a.place AS early, b.place AS late FROM prefix a JOIN prefix b ON a.t = b.t AND a.place < b.place AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), later AS (
  SELECT DISTINCT late FROM pair JOIN first a ON a.place = early JOIN first b ON b.place = late
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w))
), own AS (
  SELECT doc_id, i, row_number() OVER (ORDER BY doc_id, i) AS place, w FROM line WHERE len(w) > 0
), judged AS (
  SELECT o.doc_id, o.i FROM own o JOIN first f ON f.w = o.w LEFT JOIN later ON late = f.place WHERE late IS NOT NULL OR o.place <> f.place
), kept AS (
  SELECT l.doc_id, count(j.i) AS gone, count(*) AS n, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE j.i IS NULL) AS text
  FROM line l LEFT JOIN judged j ON l.doc_id = j.doc_id AND l.i = j.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.gone, 0) AS INTEGER) AS n_removed_lines,
  CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6, "op8_line_dedup": OP8}
