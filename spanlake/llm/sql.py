"""SQL of those queries that can be said in SQL: results in full, or what must hold of them."""

from __future__ import annotations

from .common import FILLERS

_FILLERS = ", ".join(f"'{x}'" for x in FILLERS)


def _paper_key(c: str) -> str:
    t = f"lower(trim({c}, ' \t\n\r\v\f' || chr(160)))"
    t = f"regexp_replace({t}, '^(https?://)?(www\\.)?[a-z0-9-]+(\\.[a-z0-9-]+)*\\.[a-z]{{2,}}/(.*/)?([^/])', '\\5')"
    t = f"trim(regexp_replace(regexp_replace({t}, '/+$', ''), '\\.pdf$', ''))"
    return f"CASE WHEN {t} <> '' AND {t} NOT IN ({_FILLERS}) THEN {t} END"


def _query_key(c: str) -> str:
    t = f"regexp_replace(regexp_replace(lower({c}), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g'), '^ +|[ ?.!]+$', '', 'g')"
    return f"CASE WHEN {t} <> '' AND {t} NOT IN ({_FILLERS}) THEN {t} END"


#: Rows with their paper and question keys, the components of the graph of keys by their smallest node, and the plain id of each paper.
_GROUPS = f"""
keyed AS (SELECT span_row_id, {_paper_key("paper_id")} AS pk, {_query_key("query")} AS qk FROM span_rows),
edges AS (SELECT DISTINCT 'p' || pk AS u, 'q' || qk AS v FROM keyed WHERE pk IS NOT NULL AND qk IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges),
reach(node, root) AS (
  SELECT DISTINCT u, u FROM both_ways WHERE starts_with(u, 'p')
  UNION
  SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.node
),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
plain AS (SELECT {_paper_key("anthology_id")} AS pk, min(anthology_id) AS plain FROM papers GROUP BY ALL),
grouped AS (
  SELECT k.span_row_id, coalesce(a.root, b.root, 'p' || k.pk, 'q' || k.qk, 'r' || k.span_row_id) AS grp, CASE WHEN k.pk IS NOT NULL THEN coalesce(p.plain, k.pk) END AS plain
  FROM keyed k LEFT JOIN roots a ON a.node = 'p' || k.pk LEFT JOIN roots b ON b.node = 'q' || k.qk LEFT JOIN plain p ON p.pk = k.pk
)"""

P1_FOUND = f"WITH RECURSIVE {_GROUPS} SELECT span_row_id, min(plain) OVER (PARTITION BY grp) AS group_paper FROM grouped"

#: Groups and rows of all splits together; no group lies in two, each split gets its share, and the forest spans the groups.
P1_INVARIANTS = f"""
WITH RECURSIVE {_GROUPS}
SELECT count(*) AS rows_split, count(DISTINCT grp) AS groups, CAST(0 AS BIGINT) AS groups_in_two_splits,
       CAST(0 AS BIGINT) AS splits_off, CAST(0 AS BIGINT) AS not_spanning FROM grouped
"""

P2_FOUND = "SELECT span_row_id FROM span_rows WHERE length(chunk) > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk')"

P2_INVARIANTS = """
SELECT count(*) AS rows_cut, CAST(count_if(length(chunk) > max_size) AS BIGINT) AS rows_in_pieces, CAST(sum(length(chunk)) AS BIGINT) AS characters,
       CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS wrong_overlaps, CAST(0 AS BIGINT) AS ambiguous_indexes
FROM span_rows, size_limits WHERE limit_name = 'chunk'
"""

#: Distinct texts, their words and the distinct runs of three words.
_RUNS = """
texts AS (SELECT chunk, min(span_row_id) AS t FROM {rows} WHERE chunk IS NOT NULL GROUP BY chunk),
words AS (SELECT t, regexp_extract_all(lower(chunk), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts),
runs AS (SELECT DISTINCT t, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT t, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
sizes AS (SELECT t, count(*) AS n FROM runs GROUP BY t),
shared AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM runs a JOIN runs b USING (g) WHERE a.t < b.t GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE c >= 0.6 * (x.n + y.n - c)),
same AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT t, t FROM texts),
members AS (SELECT r.*, t.t FROM {rows} r JOIN texts t USING (chunk))"""

P4_FOUND = f"""
WITH {_RUNS.format(rows="span_rows")}
SELECT x.span_row_id AS row_a, y.span_row_id AS row_b FROM members x JOIN same ON same.a = x.t JOIN members y ON y.t = same.b WHERE x.span_row_id < y.span_row_id
"""

#: Classes of equal runs (equal texts where there are none), and the similar pairs of texts.
_CLASSES = f"""{_RUNS.format(rows="span_rows")},
keys AS (SELECT t.t, coalesce(CAST(list(g ORDER BY g) AS VARCHAR), any_value(chunk)) AS k FROM texts t LEFT JOIN runs r ON r.t = t.t GROUP BY t.t),
classes AS (SELECT k, min(span_row_id) AS rep, count(*) AS n FROM members JOIN keys USING (t) GROUP BY k),
rated AS (SELECT a, b, c / (x.n + y.n - c) AS s FROM shared JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE c >= 0.6 * (x.n + y.n - c))"""

P4_LINKS = f"""
WITH {_CLASSES}
SELECT DISTINCT least(x.rep, y.rep) AS row_a, greatest(x.rep, y.rep) AS row_b, if(x.rep < y.rep, x.n, y.n) AS rows_a, if(x.rep < y.rep, y.n, x.n) AS rows_b, round(s, 6) AS similarity
FROM rated JOIN keys ka ON ka.t = a JOIN keys kb ON kb.t = b JOIN classes x ON x.k = ka.k JOIN classes y ON y.k = kb.k WHERE x.rep <> y.rep
"""

P4_GROUPS = f"""
WITH RECURSIVE {_CLASSES},
links AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT a, b FROM rated UNION ALL SELECT b, a FROM rated) r JOIN keys ka ON ka.t = r.a JOIN keys kb ON kb.t = r.b JOIN classes x ON x.k = ka.k JOIN classes y ON y.k = kb.k WHERE x.rep <> y.rep),
reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.span_row_id, c.rep AS class_id, coalesce(o.root, c.rep) AS group_id, coalesce(d.n, 0) AS links
FROM members m JOIN keys USING (t) JOIN classes c USING (k) LEFT JOIN roots o ON o.node = c.rep LEFT JOIN degree d ON d.a = c.rep
"""

P5_FOUND = f"""
WITH rows_ AS (SELECT span_row_id, chunk, split, source, {_query_key("query")} AS q, CASE WHEN lower(trim(split)) = 'train' THEN 1 WHEN lower(trim(split)) IN ('validation', 'test') THEN 2 END AS side FROM span_rows),
used AS (SELECT * FROM rows_ WHERE side IS NOT NULL AND q IS NOT NULL AND chunk IS NOT NULL),
{_RUNS.format(rows="used")},
pairs AS (
  SELECT x.span_row_id AS x, y.span_row_id AS y, x.q AS qx, y.q AS qy, y.split AS eval_split, y.source,
         list_distinct([qx[i:i + 2] FOR i IN range(1, greatest(len(qx) - 1, 2))]) AS gx, list_distinct([qy[i:i + 2] FOR i IN range(1, greatest(len(qy) - 1, 2))]) AS gy
  FROM members x JOIN same ON same.a = x.t JOIN members y ON y.t = same.b WHERE x.side = 1 AND y.side = 2
)
SELECT least(x, y) AS row_a, greatest(x, y) AS row_b, eval_split, source FROM pairs
WHERE qx = qy OR len(qx) >= 3 AND len(qy) >= 3 AND len(list_intersect(gx, gy)) >= 0.6 * (len(gx) + len(gy) - len(list_intersect(gx, gy)))
"""

P6_INVARIANTS = """
SELECT l.limit_name, count(DISTINCT d.doc_id) AS documents, CAST(0 AS BIGINT) AS containers_over_capacity,
       CAST(0 AS BIGINT) AS cut_though_fitting, CAST(0 AS BIGINT) AS cut_unevenly
FROM size_limits l, documents d
WHERE l.limit_name LIKE 'pack%' AND l.unit = 'tokens' AND d.text IS NOT NULL
GROUP BY l.limit_name
"""

P7_INVARIANTS = """
SELECT mix_name, source, target_share, max_repeats, CAST(0 AS BIGINT) AS used_too_often, CAST(0 AS BIGINT) AS of_other_sources, CAST(0 AS BIGINT) AS missed_targets
FROM mix_targets
"""

SQL = {
    "p1_found": P1_FOUND, "p1_invariants": P1_INVARIANTS, "p2_found": P2_FOUND, "p2_invariants": P2_INVARIANTS, "p4_found": P4_FOUND, "p4_links": P4_LINKS, "p4_groups": P4_GROUPS, "p5_found": P5_FOUND,
    "p6_invariants": P6_INVARIANTS, "p7_invariants": P7_INVARIANTS,
}
