"""Equivalent SQL of the core queries, for an independent engine on the same tables."""

from __future__ import annotations

SPACES = r"[\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sp(x: str) -> str:
    """Every kind of white space as a blank, one for one."""
    return f"regexp_replace({x}, '{SPACES}', ' ', 'g')"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


LAST_PAPERS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anthology_id ORDER BY coalesce(ingest_date, '') DESC, coalesce(title, '') DESC, coalesce(url, '') DESC) AS rn
 FROM papers WHERE anthology_id IS NOT NULL) WHERE rn = 1)"""
KEPT = "(language IS NULL OR language = 'English') AND coalesce(len(author), 0) > 0 AND contains(coalesce(url, ''), 'anthology.example')"
LAST_PREDICTIONS = """(SELECT * FROM (SELECT run_name, coalesce(query, question, '') AS query, coalesce(paper_id, '') AS paper_id, coalesce(chunk_index, -1) AS chunk_index, prediction_id, pred_spans, predicted_texts, latency_s, error,
 row_number() OVER (PARTITION BY run_name, coalesce(query, question, ''), coalesce(paper_id, ''), coalesce(chunk_index, -1) ORDER BY created_at DESC, prediction_id DESC) AS rn FROM predictions) WHERE rn = 1)"""
ANSWER = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"

GOLD = """(SELECT span_row_id, coalesce(query, '') AS query, coalesce(paper_id, '') AS paper_id, coalesce(chunk_index, -1) AS chunk_index, coalesce(chunk, '') AS chunk, coalesce(is_relevant, false) AS is_relevant, coalesce(gold_spans, []) AS gold
 FROM span_rows WHERE split IN ('validation', 'test'))"""
NORMALISED = f"""
 WITH j AS (SELECT r.run_name, g.*, p.pred_spans, p.predicted_texts, coalesce(p.latency_s, 0.0) AS latency, coalesce(p.error <> '', false) AS failed, {sp('g.chunk')} AS c
   FROM {GOLD} g CROSS JOIN (SELECT DISTINCT run_name FROM predictions) r
   LEFT JOIN {LAST_PREDICTIONS} p ON p.run_name = r.run_name AND p.query = g.query AND p.paper_id = g.paper_id AND p.chunk_index = g.chunk_index),
 n AS (SELECT *, CASE WHEN coalesce(len(pred_spans), 0) > 0
     THEN [{{'start': s.start, 'end': s."end"}} FOR s IN pred_spans IF s.start >= 0 AND s."end" > s.start AND s."end" <= length(chunk)]
     ELSE [{{'start': s.p, 'end': CAST(s.p + s.l AS INTEGER)}} FOR s IN [{{'p': CAST(CASE WHEN strpos(chunk, t) > 0 THEN strpos(chunk, t) - 1 ELSE strpos(lower(chunk), lower(t)) - 1 END AS INTEGER), 'l': CAST(length(t) AS INTEGER)}}
          FOR t IN coalesce(predicted_texts, []) IF t IS NOT NULL AND t <> ''] IF s.p >= 0] END AS pred FROM j),
 w AS (SELECT *, list_distinct(flatten([range(({wc('substr(c, 1, s.start)')}) - CASE WHEN s.start > 0 AND substr(c, s.start, 1) <> ' ' AND regexp_matches(substr(c, s.start, 1) || substr(c, s.start + 1, 1), '^\\S\\S$') THEN 1 ELSE 0 END, {wc('substr(c, 1, s."end")')}) FOR s IN pred])) AS pw,
   list_distinct(flatten([range(({wc('substr(c, 1, s.start)')}) - CASE WHEN s.start > 0 AND regexp_matches(substr(c, s.start, 1) || substr(c, s.start + 1, 1), '^\\S\\S$') THEN 1 ELSE 0 END, {wc('substr(c, 1, s."end")')}) FOR s IN gold IF s."end" > s.start])) AS gw FROM n),
 pairs AS (SELECT *, flatten([[{{'s': CASE WHEN least(p."end", g."end") > greatest(p.start, g.start) THEN (least(p."end", g."end") - greatest(p.start, g.start)) / ((p."end" - p.start) + (g."end" - g.start) - (least(p."end", g."end") - greatest(p.start, g.start)))::DOUBLE ELSE 0.0 END,
     'i': i, 'j': j}} FOR g, j IN gold] FOR p, i IN pred]) AS x FROM w)"""


def _greedy(t: float) -> str:
    init = "{'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'j': 0::BIGINT, 'ui': []::BIGINT[], 'uj': []::BIGINT[]}"
    elements = f"[{{'s': q.s, 'i': q.i::BIGINT, 'j': q.j::BIGINT, 'ui': []::BIGINT[], 'uj': []::BIGINT[]}} FOR q IN list_reverse_sort(x) IF q.s >= {t}]"
    step = "lambda acc, q: CASE WHEN list_contains(acc.ui, q.i) OR list_contains(acc.uj, q.j) THEN acc ELSE {'s': q.s, 'i': q.i, 'j': q.j, 'ui': list_append(acc.ui, q.i), 'uj': list_append(acc.uj, q.j)} END"
    return f"len(list_reduce({elements}, {step}, {init}).ui)"


def _inside(a: str, b: str) -> str:
    return f'greatest(0, least({a}."end", {b}."end") - greatest({a}.start, {b}.start))'


MEASURES = ", ".join(
    [
        "len(pred) AS pred_count", "len(gold) AS gold_count", "len(list_intersect(pw, gw)) AS word_tp", "len(pw) - len(list_intersect(pw, gw)) AS word_fp", "len(gw) - len(list_intersect(pw, gw)) AS word_fn",
        f"len([1 FOR g IN gold IF len([1 FOR p IN pred IF {_inside('p', 'g')} > 0]) > 0]) AS overlap_hits",
    ]
    + [f"{_greedy(t)} AS iou_tp_{round(t * 100)}" for t in (0.3, 0.5, 0.7)]
    + [f"len([1 FOR p IN pred IF len([1 FOR g IN gold IF {_inside('p', 'g')} >= {t} * (p.\"end\" - p.start)]) > 0]) AS cont_pred_{round(t * 100)}" for t in (0.5, 0.8, 1.0)]
    + [f"len([1 FOR g IN gold IF len([1 FOR p IN pred IF {_inside('p', 'g')} >= {t} * (p.\"end\" - p.start)]) > 0]) AS cont_gold_{round(t * 100)}" for t in (0.5, 0.8, 1.0)]
    + [f"len([1 FOR g IN gold IF g.\"end\" > g.start AND len(list_distinct(flatten([range(greatest(p.start, g.start), greatest(greatest(p.start, g.start), least(p.\"end\", g.\"end\"))) FOR p IN pred]))) >= {t} * (g.\"end\" - g.start)]) AS cov_{round(t * 100)}" for t in (0.5, 0.8, 1.0)]
)


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN ({p}) + ({r}) <> 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


def _summary() -> str:
    f_word = _f1(_div("word_tp", "(word_tp + word_fp)"), _div("word_tp", "(word_tp + word_fn)"))
    both = "pred_count = 0 AND gold_count = 0"
    agg = ["run_name", "count(*) AS n", "count(*) FILTER (is_relevant) AS rel", "sum(word_tp) AS tp", "sum(word_fp) AS fp", "sum(word_fn) AS fn", f"avg({f_word}) AS wm", "sum(pred_count) AS np", "sum(gold_count) AS ng", "sum(overlap_hits) AS hits", "avg(latency) AS lat", "count(*) FILTER (failed) AS err"]
    out = ["run_name", "n AS n_examples", "rel AS n_relevant", "n - rel AS n_irrelevant", f"round({_div('tp', '(tp + fp)')}, 6) AS word_micro_p", f"round({_div('tp', '(tp + fn)')}, 6) AS word_micro_r"]
    out += [f"round({_f1(_div('tp', '(tp + fp)'), _div('tp', '(tp + fn)'))}, 6) AS word_micro_f1", "round(wm, 6) AS word_macro_f1"]
    for t in (30, 50, 70):
        agg += [f"sum(iou_tp_{t}) AS i{t}", f"avg(CASE WHEN {both} THEN 1.0 ELSE {_f1(_div(f'iou_tp_{t}', 'pred_count'), _div(f'iou_tp_{t}', 'gold_count'))} END) AS im{t}"]
        out += [f"round({_f1(_div(f'i{t}', 'np'), _div(f'i{t}', 'ng'))}, 6) AS iou_micro_f1_{t}", f"round(im{t}, 6) AS iou_macro_f1_{t}"]
    for t in (50, 80, 100):
        agg += [f"sum(cont_pred_{t}) AS cp{t}", f"sum(cont_gold_{t}) AS cg{t}", f"avg(CASE WHEN {both} THEN 1.0 ELSE {_f1(_div(f'cont_pred_{t}', 'pred_count'), _div(f'cont_gold_{t}', 'gold_count'))} END) AS cm{t}", f"sum(cov_{t}) AS cv{t}"]
        out += [f"round({_f1(_div(f'cp{t}', 'np'), _div(f'cg{t}', 'ng'))}, 6) AS cont_micro_f1_{t}", f"round(cm{t}, 6) AS cont_macro_f1_{t}", f"round({_div(f'cv{t}', 'ng')}, 6) AS coverage_{t}"]
    out += [f"round({_div('hits', 'ng')}, 6) AS any_overlap_recall", f"round({_div('np', 'ng')}, 6) AS over_prediction", "round(lat, 6) AS mean_latency_s", "err AS errors"]
    return f"{NORMALISED}, m AS (SELECT run_name, is_relevant, latency, failed, {MEASURES} FROM pairs), a AS (SELECT {', '.join(agg)} FROM m GROUP BY run_name) SELECT {', '.join(out)} FROM a"


def last_run(kind: str) -> str:
    return f"(SELECT query, results FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY run_row_id DESC) AS rn FROM retrieval_runs WHERE search_type = '{kind}') WHERE rn = 1)"


def run_hits(kind: str) -> str:
    return f"(SELECT query, h.document_id, h.chunk_number, r AS rank FROM (SELECT query, unnest(results) AS h, generate_subscripts(results, 1) AS r FROM {last_run(kind)}))"


ITEM = "x.document_id || '#' || x.chunk_number"
TOP5 = "list_distinct([coalesce(x.document_id, '') || CASE WHEN x.document_id IS NULL THEN '' ELSE '#' END || x.chunk_number FOR x IN results[1:5]])"
# The patterns of the quality filter.
CITATION = r"\b(?:[A-Z][A-Za-z''`-]+(?:\s+et\s+al\.)?|\([^)]+)\s*,?\s*(?:19|20)\d{2}[a-z]?\)?"
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
REFERENCE = r"(?im)^\s{0,3}(#+\s*)?(references|bibliography)\s*$"
REASONS = f"""(SELECT span_row_id, label, source, question, CASE WHEN label <> 1 THEN NULL WHEN coalesce(len(spans), 0) = 0 THEN 'positive_without_spans' WHEN source = 'retrieved' AND retrieval_rank > 5 THEN 'rank_too_deep'
  WHEN words < 12 THEN 'span_too_short' WHEN words > 220 THEN 'span_too_long' WHEN regexp_matches(st, '{REFERENCE}') OR regexp_matches(substr(chunk, 1, 2500), '{REFERENCE}') THEN 'reference_section'
  WHEN len(regexp_extract_all(st, '{CITATION}')) / greatest(1, words)::DOUBLE > 0.12 THEN 'citation_dense' WHEN len(regexp_extract_all(st, '{YEAR}')) / greatest(1, words)::DOUBLE > 0.08 THEN 'year_dense' END AS reason
 FROM (SELECT *, {wc(sp('st'))} AS words FROM (SELECT span_row_id, query AS question, source, retrieval_rank, chunk, CASE WHEN coalesce(is_relevant, false) THEN 1 ELSE 0 END AS label, CASE WHEN coalesce(is_relevant, false) THEN gold_spans ELSE [] END AS spans,
   array_to_string([coalesce(s.text, '') FOR s IN CASE WHEN coalesce(is_relevant, false) THEN gold_spans ELSE [] END], chr(10)) AS st FROM span_rows)))"""
TOKEN_ROWS = f"(SELECT span_row_id, gold_spans, chunk, {sp('chunk')} AS c FROM span_rows WHERE chunk IS NOT NULL)"
TERMS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def merged(least: int, gap: int, first: bool) -> str:
    """Count of spans merged over gaps, short ones dropped before (first) or after."""
    src = "(SELECT prediction_id, s.start AS a, s.\"end\" AS b FROM (SELECT prediction_id, unnest(pred_spans) AS s FROM predictions) WHERE s.\"end\" > s.start)"
    before = f"WHERE b - a >= {least}" if first else ""
    islands = f"""(SELECT prediction_id, g, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY prediction_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY prediction_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new
      FROM {src} {before})) GROUP BY prediction_id, g)"""
    return islands if first else f"(SELECT * FROM {islands} WHERE b - a >= {least})"


def oracle_sql() -> dict[str, str]:
    gold_terms = TERMS.format("chunk")
    return {
        "papers_normalised": f"""SELECT anthology_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS url_id, title, CASE WHEN regexp_matches(year, '^[0-9]{{1,9}}$') THEN CAST(year AS INTEGER) END AS year,
  array_to_string(names, '; ') AS authors, len(names) AS n_authors, venue[1] AS venue, coalesce(has_markdown, false) AS has_markdown
  FROM (SELECT *, CASE WHEN len(full_names) > 0 THEN full_names ELSE coalesce([trim(x) FOR x IN string_split(author_string, ',') IF trim(x) <> ''], []) END AS names
    FROM (SELECT *, coalesce([a."full" FOR a IN author IF a."full" IS NOT NULL AND a."full" <> ''], []) AS full_names FROM {LAST_PAPERS}))""",
        "papers_kept": f"SELECT anthology_id, url, language FROM papers WHERE {KEPT}",
        "papers_fulltext": """SELECT volume_id, count(DISTINCT d.anthology_id) AS papers, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d JOIN (SELECT DISTINCT anthology_id FROM papers WHERE anthology_id IS NOT NULL) p ON p.anthology_id = d.anthology_id
  WHERE text IS NOT NULL GROUP BY volume_id""",
        "papers_without_text": "SELECT DISTINCT anthology_id FROM papers WHERE anthology_id IS NOT NULL AND anthology_id NOT IN (SELECT anthology_id FROM documents WHERE text IS NOT NULL AND anthology_id IS NOT NULL)",
        "document_stats": f"SELECT source, lower(lang) AS lang, count(*) AS documents, CAST(sum({wc(sp(chr(34) + 'text' + chr(34)))}) AS BIGINT) AS words, max(length(text)) AS longest FROM (SELECT source, lang, coalesce(text, '') AS text FROM documents) GROUP BY ALL",
        "unique_texts": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text",
        "latin_titles": r"SELECT DISTINCT anthology_id, url, coalesce(NOT regexp_matches(regexp_replace(title, '\p{Latin}', '', 'g'), '\p{L}'), false) AS latin FROM papers",
        "span_sanity": """SELECT source, count(*) AS spans, count(*) FILTER (bad) AS out_of_bounds, count(*) FILTER (NOT bad AND substr(chunk, g.start + 1, g."end" - g.start) <> g.text) AS other_text
  FROM (SELECT *, g.start < 0 OR g."end" < g.start OR g."end" > length(chunk) AS bad FROM (SELECT source, chunk, unnest(gold_spans) AS g FROM span_rows)) GROUP BY source""",
        "gold_alignment": """SELECT span_row_id, n, CASE WHEN e > 0 THEN 'exact' WHEN f > 0 THEN 'case' ELSE 'none' END AS tier, CASE WHEN e > 0 THEN e - 1 WHEN f > 0 THEN f - 1 END AS start
  FROM (SELECT span_row_id, n, strpos(chunk, raw) AS e, strpos(lower(chunk), lower(raw)) AS f FROM (SELECT span_row_id, chunk, unnest(gold_spans_raw) AS raw, generate_subscripts(gold_spans_raw, 1) - 1 AS n FROM span_rows) WHERE raw IS NOT NULL AND raw <> '')""",
        "merged_spans": f'SELECT prediction_id, row_number() OVER (PARTITION BY prediction_id ORDER BY a) - 1 AS n, a AS start, b AS "end" FROM {merged(0, 1, True)}',
        "post_processed_spans": f"""SELECT p.prediction_id, coalesce(x.n, 0) AS filtered_then_merged, coalesce(y.n, 0) AS merged_then_filtered FROM predictions p
  LEFT JOIN (SELECT prediction_id, count(*) AS n FROM {merged(100, 30, True)} GROUP BY 1) x USING (prediction_id) LEFT JOIN (SELECT prediction_id, count(*) AS n FROM {merged(100, 30, False)} GROUP BY 1) y USING (prediction_id) WHERE p.pred_spans IS NOT NULL""",
        "word_ranges": f"""SELECT span_row_id, n, ({wc('substr(c, 1, g.start)')}) - CASE WHEN g.start > 0 AND regexp_matches(substr(c, g.start, 2), '^\\S\\S$') THEN 1 ELSE 0 END AS first_word, {wc('substr(c, 1, g."end")')} AS end_word
  FROM (SELECT span_row_id, {sp('chunk')} AS c, unnest(gold_spans) AS g, generate_subscripts(gold_spans, 1) - 1 AS n FROM span_rows) WHERE g."end" > g.start""",
        "span_eval_rows": f"{NORMALISED} SELECT run_name, span_row_id, {MEASURES} FROM pairs",
        "span_eval_summary": _summary(),
        "predictions_last": f"SELECT run_name, query, paper_id, chunk_index, prediction_id FROM {LAST_PREDICTIONS}",
        "gold_ranks": """SELECT run_row_id, search_type, query, gold_paper, gold_chunk, list_min([i FOR x, i IN results IF x.document_id = gold_paper]) AS paper_rank, list_min([i FOR x, i IN results IF x.document_id = gold_paper AND x.chunk_number = gold_chunk]) AS chunk_rank FROM retrieval_runs""",
        "recall_at_k": """SELECT search_type, k, count(*) AS queries, count(DISTINCT gold_paper) AS papers, count(DISTINCT CASE WHEN gold_paper IS NOT NULL AND gold_chunk IS NOT NULL THEN (gold_paper, gold_chunk) END) AS chunks,
  round(count(*) FILTER (p <= k) / count(*)::DOUBLE, 6) AS paper_recall, round(count(*) FILTER (c <= k) / count(*)::DOUBLE, 6) AS chunk_recall
  FROM (SELECT *, list_min([i FOR x, i IN results IF x.document_id = gold_paper]) AS p, list_min([i FOR x, i IN results IF x.document_id = gold_paper AND x.chunk_number = gold_chunk]) AS c FROM retrieval_runs),
  (SELECT unnest([1, 3, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000]) AS k) GROUP BY search_type, k""",
        "run_overlap": f"""SELECT count(*) AS queries, CAST(sum(i) AS BIGINT) AS shared, CAST(sum(u) AS BIGINT) AS either, round(avg(CASE WHEN u > 0 THEN i / u::DOUBLE ELSE 0 END), 6) AS mean_iou, round(sum(i) / sum(u)::DOUBLE, 6) AS global_iou
  FROM (SELECT len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM (SELECT query, {TOP5} AS x FROM {last_run('hybrid')}) JOIN (SELECT query, {TOP5} AS y FROM {last_run('dense')}) USING (query))""",
        "run_spearman": f"""SELECT count(*) AS pairs, round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY ra) + (count(*) OVER (PARTITION BY ra) - 1) / 2.0 AS a, rank() OVER (ORDER BY rb) + (count(*) OVER (PARTITION BY rb) - 1) / 2.0 AS b
  FROM (SELECT query, document_id, chunk_number, max(rank) AS ra FROM {run_hits('hybrid')} GROUP BY ALL) JOIN (SELECT query, document_id, chunk_number, max(rank) AS rb FROM {run_hits('dense')} GROUP BY ALL) USING (query, document_id, chunk_number))""",
        "rrf_fusion": f"""SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT query, item, round(sum(w / (60 + r)), 9) AS score
  FROM (SELECT query, document_id || '#' || chunk_number AS item, 0.7 AS w, min(rank) AS r FROM {run_hits('hybrid')} GROUP BY ALL UNION ALL SELECT query, document_id || '#' || chunk_number, 0.3, min(rank) FROM {run_hits('dense')} GROUP BY ALL) GROUP BY ALL)) WHERE rank <= 5""",
        "bm25_search": f"""WITH t AS (SELECT span_row_id AS item, unnest({gold_terms}) AS term FROM span_rows), p AS (SELECT item, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT span_row_id AS item, coalesce(len({gold_terms}), 0) AS len FROM span_rows),
  s AS (SELECT count(*) AS n, avg(len) AS al FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT query_id, term FROM (SELECT span_row_id AS query_id, unnest({TERMS.format('query')}) AS term FROM span_rows WHERE span_row_id % 20 = 0)),
  x AS (SELECT query_id, item, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN p USING (term) JOIN l USING (item) JOIN f USING (term), s GROUP BY ALL)
  SELECT query_id, rank, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM x) WHERE rank <= 10""",
        "cosine_search": """SELECT query_id, rank, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS item,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10""",
        "silver_candidates": """WITH c AS (SELECT run_row_id, gold_paper AS paper_id, gold_chunk AS chunk_index, NULL::INTEGER AS retrieval_rank, 'gold' AS source FROM retrieval_runs WHERE gold_paper IS NOT NULL AND gold_chunk IS NOT NULL
  UNION ALL SELECT run_row_id, x.document_id, x.chunk_number, r, 'retrieved' FROM (SELECT run_row_id, gold_paper, gold_chunk, unnest(results[1:3]) AS x, generate_subscripts(results[1:3], 1) AS r FROM retrieval_runs) WHERE NOT (x.document_id IS NOT DISTINCT FROM gold_paper AND x.chunk_number IS NOT DISTINCT FROM gold_chunk))
  SELECT c.run_row_id, c.source, c.paper_id, c.chunk_index, c.retrieval_rank, length(t.chunk) AS chunk_chars FROM c LEFT JOIN (SELECT paper_id, chunk_index, arg_min(chunk, span_row_id) AS chunk FROM span_rows WHERE paper_id IS NOT NULL AND chunk IS NOT NULL GROUP BY ALL) t ON t.paper_id = c.paper_id AND t.chunk_index = c.chunk_index""",
        "silver_drop_reasons": f"SELECT span_row_id, label, reason FROM {REASONS}",
        "silver_filter_summary": f"SELECT reason, count(*) AS rows, count(*) FILTER (label = 1) AS positives, count(DISTINCT question) AS questions FROM {REASONS} GROUP BY reason",
        "group_split": """WITH h AS (SELECT span_row_id, md5('1337|' || coalesce(query, '') || '|' || coalesce(gold_paper_id, '') || '|' || coalesce(gold_chunk_index::VARCHAR, '')) AS h FROM span_rows), g AS (SELECT h, row_number() OVER (ORDER BY h) AS r FROM (SELECT DISTINCT h FROM h)),
  n AS (SELECT greatest(1, round_even(count(*) * 0.1, 0)) AS d FROM g) SELECT span_row_id, CASE WHEN r <= d THEN 'dev' ELSE 'train' END AS split FROM h JOIN g USING (h), n""",
        "negatives_sampled": """WITH r AS (SELECT query, span_row_id, coalesce(is_relevant, false) AS label FROM span_rows WHERE query IS NOT NULL AND query <> '') SELECT span_row_id, label FROM r WHERE label
  UNION ALL SELECT span_row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY md5('1337|' || query || '|' || span_row_id)) AS n FROM r WHERE NOT label) JOIN (SELECT query, count(*) FILTER (label) AS p FROM r GROUP BY query) USING (query) WHERE n <= p""",
        "papers_sampled": f"SELECT anthology_id FROM (SELECT DISTINCT anthology_id FROM papers WHERE {KEPT}) ORDER BY md5('1337|' || coalesce(anthology_id, '')) LIMIT 50",
        "chunks_sampled": "SELECT paper_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY md5('1337|' || coalesce(chunk_index::VARCHAR, '')), chunk_index) AS n FROM (SELECT DISTINCT paper_id, chunk_index FROM span_rows WHERE paper_id IS NOT NULL)) WHERE n <= 2",
        "resume_pending": "SELECT span_row_id FROM span_rows s WHERE split IN ('validation', 'test') AND NOT EXISTS (SELECT 1 FROM predictions p WHERE run_name = 'encoder_small' AND coalesce(p.query, p.question, '') = s.query AND coalesce(p.paper_id, '') = s.paper_id AND coalesce(p.chunk_index, -1) = s.chunk_index)",
        "sources_tagged": "SELECT source_dataset, source, count(*) AS rows, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT 'span_rows' AS source_dataset, source, length(chunk) AS chars FROM span_rows UNION ALL SELECT 'documents', source, length(text) FROM documents) GROUP BY ALL",
        "label_rollup": "SELECT source, split, count(*) AS rows, round(avg(y), 6) AS positive_share FROM (SELECT source, coalesce(split, 'none') AS split, CASE WHEN is_relevant THEN 1 ELSE 0 END AS y FROM span_rows) GROUP BY ROLLUP (source, split)",
        "annotation_actions": """SELECT span_row_id, CASE WHEN contains(l, '?') THEN 'clear' WHEN l NOT IN ('', 'n', 'r') THEN 'error: unknown label' WHEN l = 'n' AND h THEN 'error: gold text on an irrelevant hit' WHEN l = 'r' AND NOT h THEN 'error: relevant without gold text' WHEN l = '' THEN 'skip' ELSE 'keep' END AS action
  FROM (SELECT span_row_id, coalesce(trim(relevance_label), '') AS l, coalesce(len(gold_spans_raw), 0) > 0 AS h FROM span_rows)""",
        "answer_match": f"""WITH g AS (SELECT query, paper_id, chunk_index, list_distinct(list(a)) AS gold FROM (SELECT query, paper_id, chunk_index, unnest([{ANSWER.format(sp('s.text'))} FOR s IN gold_spans]) AS a FROM span_rows WHERE split IN ('validation', 'test') AND gold_spans IS NOT NULL AND query IS NOT NULL AND paper_id IS NOT NULL) GROUP BY ALL),
  k AS (SELECT DISTINCT query, paper_id, chunk_index FROM span_rows WHERE split IN ('validation', 'test') AND gold_spans IS NOT NULL AND query IS NOT NULL AND paper_id IS NOT NULL),
  p AS (SELECT run_name, query, paper_id, chunk_index, list_distinct([{ANSWER.format(sp("coalesce(s.text, '')"))} FOR s IN coalesce(pred_spans, [])]) AS pred FROM {LAST_PREDICTIONS})
  SELECT run_name, count(*) AS rows, CAST(sum(len(list_intersect(pred, coalesce(gold, [])))) AS BIGINT) AS matched, CAST(sum(len(pred)) AS BIGINT) AS predicted, CAST(sum(len(coalesce(gold, []))) AS BIGINT) AS expected FROM p JOIN k USING (query, paper_id, chunk_index) LEFT JOIN g USING (query, paper_id, chunk_index) GROUP BY run_name""",
        "token_windows": f"""SELECT span_row_id, w AS window, w * 96 AS first, len(t) AS length, md5(array_to_string(t, ' ')) AS hash FROM (SELECT span_row_id, w, words[w * 96 + 1 : w * 96 + 128] AS t FROM (SELECT span_row_id, words, unnest(range(0, greatest(0, CAST(ceil((len(words) - 128) / 96.0) AS BIGINT)) + 1)) AS w
  FROM (SELECT span_row_id, regexp_extract_all(c, '\\S+') AS words FROM {TOKEN_ROWS}) WHERE len(words) > 0))""",
        "token_labels": f"""WITH r AS (SELECT span_row_id, {wc('c')} AS words, list_sort(list_distinct(flatten([range(({wc('substr(c, 1, s.start)')}) - CASE WHEN s.start > 0 AND regexp_matches(substr(c, s.start, 2), '^\\S\\S$') THEN 1 ELSE 0 END, {wc('substr(c, 1, s."end")')}) FOR s IN gold_spans IF s."end" > s.start]))) AS p FROM {TOKEN_ROWS} WHERE len(gold_spans) > 0)
  SELECT span_row_id, words, len(p) AS positive, len([x FOR x, i IN p IF i = 1 OR p[i - 1] <> x - 1]) AS runs FROM r""",
        "token_scores": f"""WITH r AS (SELECT source, {wc('c')} AS n, list_distinct(flatten([range(({wc('substr(c, 1, s.start)')}) - CASE WHEN s.start > 0 AND regexp_matches(substr(c, s.start, 2), '^\\S\\S$') THEN 1 ELSE 0 END, {wc('substr(c, 1, s."end")')}) FOR s IN gold_spans IF s."end" > s.start])) AS g,
    list_distinct(flatten([range(({wc('substr(c, 1, s.start)')}) - CASE WHEN s.start > 0 AND regexp_matches(substr(c, s.start, 2), '^\\S\\S$') THEN 1 ELSE 0 END, {wc('substr(c, 1, s."end")')}) FOR s IN coalesce(baseline_extraction, []) IF s."end" > s.start])) AS p FROM (SELECT source, gold_spans, baseline_extraction, {sp('chunk')} AS c FROM span_rows WHERE chunk IS NOT NULL AND gold_spans IS NOT NULL)),
  a AS (SELECT source, CAST(sum(len(list_intersect(p, g))) AS BIGINT) AS tp, CAST(sum(len(p) - len(list_intersect(p, g))) AS BIGINT) AS fp, CAST(sum(len(g) - len(list_intersect(p, g))) AS BIGINT) AS fn, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY source)
  SELECT source, tp, fp, fn, tokens, round({_div('tp', '(tp + fp)')}, 6) AS precision, round({_div('tp', '(tp + fn)')}, 6) AS recall, round({_f1(_div('tp', '(tp + fp)'), _div('tp', '(tp + fn)'))}, 6) AS f1 FROM a""",
        "reranked_runs": f"""SELECT query, new_rank, rank, document_id, chunk_number FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, rank) AS new_rank FROM (SELECT query, r AS rank, h.document_id, h.chunk_number,
  CASE WHEN h.title IS NOT NULL THEN len(list_intersect(list_distinct(regexp_split_to_array(lower(h.title), '[^a-z0-9]+')), list_distinct(regexp_split_to_array(lower(query), '[^a-z0-9]+')))) END AS score
  FROM (SELECT query, unnest(results) AS h, generate_subscripts(results, 1) AS r FROM {last_run('hybrid')}) WHERE r <= 20)) WHERE new_rank <= 5""",
        "events_hourly": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL",
        "sparse_search": f"""WITH d AS (SELECT item, term, 1 + ln(count(*)) AS w FROM (SELECT span_row_id AS item, unnest({gold_terms}) AS term FROM span_rows) GROUP BY ALL),
  q AS (SELECT query_id, term, 1 + ln(count(*)) AS v FROM (SELECT span_row_id AS query_id, unnest({TERMS.format('query')}) AS term FROM span_rows WHERE span_row_id % 20 = 0) GROUP BY ALL),
  x AS (SELECT query_id, item, round(sum(w * v), 6) AS score FROM q JOIN d USING (term) GROUP BY ALL) SELECT query_id, rank, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM x) WHERE rank <= 10""",
        "filtered_rows": "SELECT span_row_id, source, chunk_index FROM span_rows WHERE source = 'gold' AND chunk_index > 2 AND paper_id LIKE '%quill%'",
        "runs_gold_difference": """WITH a AS (SELECT DISTINCT query, gold_paper, gold_chunk FROM retrieval_runs WHERE search_type = 'hybrid'), b AS (SELECT DISTINCT query, gold_paper, gold_chunk FROM retrieval_runs WHERE search_type = 'dense')
  SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
        "silver_records": """WITH c AS (SELECT run_row_id, query, gold_paper AS paper_id, gold_chunk AS chunk_index, 'gold' AS source FROM retrieval_runs WHERE gold_paper IS NOT NULL AND gold_chunk IS NOT NULL
  UNION ALL SELECT run_row_id, query, x.document_id, x.chunk_number, 'retrieved' FROM (SELECT run_row_id, query, gold_paper, gold_chunk, unnest(results[1:3]) AS x FROM retrieval_runs) WHERE NOT (x.document_id IS NOT DISTINCT FROM gold_paper AND x.chunk_number IS NOT DISTINCT FROM gold_chunk)),
  r AS (SELECT query, paper_id, chunk_index, arg_min(gold_spans, span_row_id) AS spans FROM span_rows WHERE is_relevant AND query IS NOT NULL AND paper_id IS NOT NULL GROUP BY ALL)
  SELECT run_row_id, source, c.paper_id, c.chunk_index, CASE WHEN source = 'gold' OR r.query IS NOT NULL THEN 1 ELSE 0 END AS label, coalesce(len(r.spans), 0) AS spans FROM c LEFT JOIN r ON r.query = c.query AND r.paper_id = c.paper_id AND r.chunk_index = c.chunk_index""",
        "conversion_plan": """SELECT anthology_id, min(pdf) AS path FROM papers WHERE pdf IS NOT NULL AND anthology_id IS NOT NULL AND anthology_id <> '1968.tallow-primer.1'
  AND anthology_id NOT IN (SELECT anthology_id FROM documents WHERE source = 'paper_body' AND text IS NOT NULL AND anthology_id IS NOT NULL) GROUP BY anthology_id""",
        "generative_examples": """SELECT md5(p) AS prompt_hash, length(p) AS prompt_chars, a AS answerable FROM (SELECT 'Question: ' || coalesce(query, '') || chr(10) || chr(10) || 'Text:' || chr(10) || chunk || chr(10) || chr(10) || 'Quote the passages that answer the question.' AS p,
  coalesce(is_relevant, false) AND coalesce(len(gold_spans), 0) > 0 AS a FROM span_rows WHERE chunk IS NOT NULL)""",
        "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS rows FROM lineitem GROUP BY ALL",
        "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "first_per_group": "SELECT query, n, span_row_id FROM (SELECT query, span_row_id, row_number() OVER (PARTITION BY query ORDER BY retrieval_rank, span_row_id) AS n FROM span_rows WHERE query IS NOT NULL AND retrieval_rank IS NOT NULL) WHERE n <= 3",
    }
