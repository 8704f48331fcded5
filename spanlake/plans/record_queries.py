"""Registered queries on records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, records, retrieval
from . import sql as Q

SOURCES = ("gold", "retrieved", "silver", "qasper", "ragbench")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def paper_chunks(s: SparkSession, d: str) -> DataFrame:
    """All chunks of every paper: their indexes in order."""
    r = table(s, d, "span_rows").where("paper_id is not null and chunk_index is not null").select("paper_id", "chunk_index").distinct()
    return r.groupBy("paper_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("x")).select("paper_id", F.size("x").alias("chunks"), F.array_join(F.transform("x", lambda i: i.cast("string")), ",").alias("indexes"))


def spans_repaired(s: SparkSession, d: str) -> DataFrame:
    """Spans of the last predictions, checked against the chunk and moved or dropped where they don't hold."""
    p = evaluate.last_predictions(table(s, d, "predictions"), ["run_name"])
    texts = table(s, d, "span_rows").where("query is not null and paper_id is not null and chunk is not null").groupBy("query", "paper_id", "chunk_index").agg(F.min_by("chunk", "span_row_id").alias("chunk"))
    j = p.join(texts, ["query", "paper_id", "chunk_index"]).withColumn("r", records.repaired_spans(F.col("pred_spans"), F.col("chunk")))
    flat = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return j.select("prediction_id", F.size("r").alias("spans"), flat.alias("places"))


def language_counts(s: SparkSession, d: str) -> DataFrame:
    """Languages found by running words beside those recorded."""
    x = table(s, d, "documents").select(F.lower("lang").alias("recorded"), records.language(F.col("text")).alias("found"))
    return x.groupBy("recorded", "found").agg(F.count("*").alias("documents"))


def gold_nested(s: SparkSession, d: str) -> DataFrame:
    """Gold records by query, in short: hits, relevant hits and extracted texts."""
    r = table(s, d, "span_rows").select("query", "paper_id", "chunk_index", "chunk", F.coalesce("is_relevant", F.lit(False)).cast("int").alias("label"), F.col("gold_spans").alias("spans"))
    g = records.gold_records(r)
    return g.select("query", F.size("results").alias("hits"), F.size(F.filter("results", lambda x: x["relevant"] == 1)).alias("relevant"), F.aggregate("results", F.lit(0), lambda a, x: a + F.size(x["extraction"])).alias("texts"))


def annotated_kept(s: SparkSession, d: str) -> DataFrame:
    """Annotated hits with a label, counted by query."""
    k = records.kept_hits(table(s, d, "span_rows").select("query", "relevance_label"), "query", "relevance_label")
    return k.groupBy("query").agg(F.count("*").alias("hits"))


def gold_totals(s: SparkSession, d: str) -> DataFrame:
    return records.gold_summary(table(s, d, "span_rows"), ["source", "split"])


def answers_by_question(s: SparkSession, d: str) -> DataFrame:
    """Predicted texts by question, the first row of a query being its id."""
    q = table(s, d, "span_rows").where("query is not null and query != ''").groupBy("query").agg(F.min("span_row_id").alias("question_id"))
    p = table(s, d, "predictions").select(F.coalesce("query", "question").alias("query"), "predicted_texts")
    return records.question_ids(p, q).select("question_id", F.size("texts").alias("texts"))


def source_definitions(s: SparkSession, d: str) -> DataFrame:
    """Rows by source with its definition, unknown ones with an error."""
    names = s.createDataFrame([(x, f"rows of {x}") for x in SOURCES], "name string, definition string")
    x = records.defined(table(s, d, "span_rows").select("source"), "source", names)
    return x.groupBy("source", "definition", "error").agg(F.count("*").alias("rows"))


def unknown_sources(s: SparkSession, d: str) -> DataFrame:
    return records.unknown_values(table(s, d, "span_rows"), "source", list(SOURCES))


def sheet_layout(s: SparkSession, d: str) -> DataFrame:
    """Lines of the rows of a sheet by query with a blank line after every five."""
    r = table(s, d, "span_rows").where("query is not null").select("query", "span_row_id")
    return records.sheet_lines(r, ["query", "span_row_id"], 5).select("span_row_id", "line")


def entity_export(s: SparkSession, d: str) -> DataFrame:
    """The rows of every query as one text with entities, by their number and places."""
    r = table(s, d, "span_rows").where("query is not null").select(F.col("query").alias("doc"), F.col("span_row_id").alias("n"), "chunk", F.col("gold_spans").alias("spans"))
    e = records.entities(r)
    total = lambda f: F.sum(F.aggregate("entities", F.lit(0).cast("bigint"), lambda a, x: a + x[f]))
    return e.groupBy(F.col("doc").alias("query")).agg(F.max(F.col("at") + F.col("length")).alias("chars"), F.sum(F.size("entities")).alias("entities"), total("start").alias("starts"), total("end").alias("ends"))


def conversion_status(s: SparkSession, d: str) -> DataFrame:
    """Papers with a file by whether their text came out."""
    done = table(s, d, "documents").where("source = 'paper_body' and trim(text) != ''").select("anthology_id").distinct().withColumn("ok", F.lit(1))
    p = table(s, d, "papers").where("pdf is not null and anthology_id is not null").select("anthology_id").distinct().join(done, "anthology_id", "left")
    return p.groupBy(F.when(F.col("ok") == 1, "converted").otherwise("failed").alias("status")).agg(F.count("*").alias("papers"))


def enhanced_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks as they are indexed, under their paper's title, by hash."""
    t = table(s, d, "papers").where("anthology_id is not null").groupBy("anthology_id").agg(F.min("title").alias("title"))
    r = table(s, d, "span_rows").select("span_row_id", "paper_id", "chunk")
    j = r.join(t, r.paper_id == t.anthology_id, "left")
    return j.select("span_row_id", F.md5(records.enhanced(F.col("chunk"), F.col("title"))).alias("hash"))


def filtered_search(s: SparkSession, d: str) -> DataFrame:
    """BM25 over the rows that a search filter leaves."""
    rule = retrieval.filter_expression('source == "gold" and metadata["chunk_index"] > 2')
    docs = table(s, d, "span_rows").where(rule).select(F.col("span_row_id").alias("item"), F.col("chunk").alias("text"))
    asked = table(s, d, "span_rows").where("span_row_id % 20 = 0 and query is not null").select(F.col("span_row_id").alias("query_id"), F.col("query").alias("query_text"))
    return retrieval.bm25(docs, asked, 5)


def _filled(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "span_rows").where("query is not null and paper_id is not null").groupBy("query", "paper_id", "chunk_index").agg(F.min_by("baseline_extraction", "span_row_id").alias("spans"))
    return records.filled_results(table(s, d, "retrieval_runs"), x)


def results_filled(s: SparkSession, d: str) -> DataFrame:
    """Saved results with the baseline's extraction of the first row that has the hit."""
    return _filled(s, d).select("run_row_id", "rank", "document_id", "chunk_number", F.size("extraction").alias("spans"))


def rag_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers by template from the first three hits with an extraction."""
    q = table(s, d, "retrieval_runs").select("run_row_id", "query")
    a = records.answers(_filled(s, d).join(q, "run_row_id"), 3)
    return a.select("run_row_id", "sources", F.md5("answer").alias("answer_hash"))


def answerable_counts(s: SparkSession, d: str) -> DataFrame:
    """Answers read as yes or no: labels of rows as a provider would say them."""
    said = F.when(F.col("is_relevant"), F.lit('{"answerable": true}')).when(F.col("relevance_label") == "n", F.lit("No, it isn't.")).otherwise(F.col("relevance_label"))
    x = table(s, d, "span_rows").select(records.answerability(said, False).alias("answerable"), records.answerability(said, True).alias("if_invalid_true"))
    return x.groupBy("answerable", "if_invalid_true").agg(F.count("*").alias("rows"))


NAMES = [
    "paper_chunks", "spans_repaired", "language_counts", "gold_nested", "annotated_kept", "gold_totals", "answers_by_question", "source_definitions", "unknown_sources", "sheet_layout", "entity_export", "conversion_status", "enhanced_chunks", "filtered_search", "results_filled", "rag_answers", "answerable_counts",
]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, paper_id, chunk_index ORDER BY span_row_id) AS rn FROM span_rows WHERE query IS NOT NULL AND paper_id IS NOT NULL{0}) WHERE rn = 1)"
_HITS = "(SELECT run_row_id, query, unnest(results) AS h, generate_subscripts(results, 1) AS rank FROM retrieval_runs)"
_FILLED = f"""(SELECT h.run_row_id, h.query, h.rank, h.h.document_id AS document_id, h.h.chunk_number AS chunk_number, coalesce(f.baseline_extraction, []) AS extraction
 FROM {_HITS} h LEFT JOIN {_FIRST.format('')} f ON f.query = h.query AND f.paper_id = h.h.document_id AND f.chunk_index = h.h.chunk_number)"""
_KNOWN = ", ".join(f"'{x}'" for x in SOURCES)


def _language() -> str:
    codes = sorted(records.STOPWORDS)
    n = {c: "len([w FOR w IN words IF w IN (" + ", ".join(f"'{w}'" for w in records.STOPWORDS[c]) + ")])" for c in codes}
    best = f"greatest({', '.join(n.values())})"
    arms = " ".join(f"WHEN {n[c]} = {best} THEN '{c}'" for c in codes)
    return f"""SELECT recorded, CASE WHEN text IS NULL THEN NULL WHEN length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) * 5 > length(text) THEN 'zh' WHEN {best} = 0 THEN 'other' {arms} END AS found, count(*) AS documents
 FROM (SELECT lower(lang) AS recorded, text, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS words FROM documents) GROUP BY ALL"""


def _line_metrics() -> str:
    """Line measures of the last predictions for relevant rows."""

    def touched(spans: str) -> str:
        return f"""list_distinct([rtrim(x.l, ' ') FOR x IN ls IF trim(x.l, ' ') <> '' AND len([1 FOR s IN {spans} IF s.start < x.s + length(x.l) AND s."end" > x.s]) > 0])"""

    words = lambda x: Q.wc(Q.sp(x))
    div = lambda a, b: f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0.0)"
    measures = {
        "line_p": f"CASE WHEN np = 0 AND ng = 0 THEN 1.0 ELSE {div('c', 'np')} END", "line_r": f"CASE WHEN np = 0 AND ng = 0 THEN 1.0 ELSE {div('c', 'ng')} END", "line_f1": f"CASE WHEN np = 0 AND ng = 0 THEN 1.0 ELSE {div('2 * c', '(np + ng)')} END",
        "exact": "CASE WHEN c = np AND c = ng THEN 1.0 ELSE 0.0 END", "empty_right": "CASE WHEN (np = 0) = (ng = 0) THEN 1.0 ELSE 0.0 END", "compression": f"1 - {div('kept', 'length(chunk)')}", "word_share": div("pw", words("chunk")),
    }
    out = ", ".join(f"round(avg({m}::DOUBLE), 4) AS {n}_mean, round(median({m}::DOUBLE), 4) AS {n}_median" for n, m in measures.items())
    return f"""WITH j AS (SELECT r.run_name, g.chunk, coalesce(g.gold_spans, []) AS gs, coalesce(p.pred_spans, []) AS ps, string_split(g.chunk, chr(10)) AS parts
   FROM (SELECT * FROM span_rows WHERE split IN ('validation', 'test') AND is_relevant AND chunk IS NOT NULL) g CROSS JOIN (SELECT DISTINCT run_name FROM predictions) r
   LEFT JOIN {Q.LAST_PREDICTIONS} p ON p.run_name = r.run_name AND p.query = coalesce(g.query, '') AND p.paper_id = coalesce(g.paper_id, '') AND p.chunk_index = g.chunk_index),
 o AS (SELECT *, [{{'s': length(array_to_string(parts[1:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END, 'l': parts[i]}} FOR i IN range(1, len(parts) + 1)] AS ls FROM j),
 t AS (SELECT run_name, chunk, {touched('ps')} AS p, {touched('gs')} AS g FROM o),
 m AS (SELECT *, len(p) AS np, len(g) AS ng, len(list_intersect(p, g)) AS c, length(array_to_string(p, chr(10))) AS kept, {words("array_to_string(p, ' ')")} AS pw FROM t)
 SELECT run_name, count(*) AS n, {out} FROM m GROUP BY run_name"""


def oracle_sql() -> dict[str, str]:
    good = 's.start >= 0 AND s."end" > s.start AND s."end" <= length(chunk) AND substr(chunk, s.start + 1, s."end" - s.start) = s.text'
    terms = Q.TERMS
    return {
        "line_metrics": _line_metrics(),
        "paper_chunks": "SELECT paper_id, CAST(count(*) AS INTEGER) AS chunks, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS indexes FROM (SELECT DISTINCT paper_id, chunk_index FROM span_rows WHERE paper_id IS NOT NULL AND chunk_index IS NOT NULL) GROUP BY paper_id",
        "spans_repaired": f"""SELECT prediction_id, CAST(len(r) AS INTEGER) AS spans, array_to_string([x.a || ':' || x.b FOR x IN r], ',') AS places FROM (SELECT prediction_id, [{{'a': CASE WHEN coalesce({good}, false) THEN s.start ELSE strpos(chunk, s.text) - 1 END, 'b': CASE WHEN coalesce({good}, false) THEN s."end" ELSE strpos(chunk, s.text) - 1 + length(s.text) END}}
  FOR s IN coalesce(pred_spans, []) IF coalesce({good}, false) OR coalesce(length(s.text) > 0 AND strpos(chunk, s.text) > 0, false)] AS r
  FROM {Q.LAST_PREDICTIONS} p JOIN {_FIRST.format(' AND chunk IS NOT NULL')} c ON c.query = p.query AND c.paper_id = p.paper_id AND c.chunk_index = p.chunk_index)""",
        "language_counts": _language(),
        "gold_nested": "SELECT query, CAST(count(*) AS INTEGER) AS hits, CAST(count_if(coalesce(is_relevant, false)) AS INTEGER) AS relevant, CAST(coalesce(sum(len(gold_spans)) FILTER (WHERE is_relevant), 0) AS INTEGER) AS texts FROM span_rows GROUP BY query",
        "annotated_kept": "SELECT query, count(*) AS hits FROM span_rows WHERE query IS NOT NULL AND trim(coalesce(relevance_label, '')) <> '' GROUP BY query",
        "gold_totals": "SELECT source, split, count(*) AS rows, count(DISTINCT query) AS queries, CAST(count_if(coalesce(is_relevant, false)) AS BIGINT) AS relevant, CAST(sum(coalesce(len(gold_spans), 0)) AS BIGINT) AS spans, CAST(sum(coalesce(len(gold_spans_raw), 0)) AS BIGINT) AS raw_texts, CAST(count_if(coalesce(len(gold_spans), 0) < coalesce(len(gold_spans_raw), 0)) AS BIGINT) AS rows_unaligned FROM span_rows GROUP BY ALL",
        "answers_by_question": """SELECT q.question_id, CAST(count(DISTINCT p.t) AS INTEGER) AS texts FROM (SELECT query, min(span_row_id) AS question_id FROM span_rows WHERE query <> '' GROUP BY query) q
  LEFT JOIN (SELECT coalesce(query, question) AS query, unnest(predicted_texts) AS t FROM predictions) p ON p.query = q.query GROUP BY q.question_id""",
        "source_definitions": f"SELECT source, CASE WHEN source IN ({_KNOWN}) THEN 'rows of ' || source END AS definition, CASE WHEN source IN ({_KNOWN}) THEN NULL ELSE 'unknown type: ' || coalesce(source, 'null') END AS error, count(*) AS rows FROM span_rows GROUP BY ALL",
        "unknown_sources": f"SELECT source, count(*) AS rows FROM span_rows WHERE NOT coalesce(source IN ({_KNOWN}), false) GROUP BY source",
        "sheet_layout": "SELECT span_row_id, n + (n - 1) // 5 AS line FROM (SELECT span_row_id, row_number() OVER (ORDER BY query, span_row_id) AS n FROM span_rows WHERE query IS NOT NULL)",
        "entity_export": """WITH r AS (SELECT query, span_row_id, coalesce(chunk, '') AS chunk, coalesce(gold_spans, []) AS g, sum(length(coalesce(chunk, '')) + 2) OVER (PARTITION BY query ORDER BY span_row_id) - length(coalesce(chunk, '')) - 2 AS pos FROM span_rows WHERE query IS NOT NULL)
  SELECT query, CAST(sum(length(chunk) + 2) - 2 AS BIGINT) AS chars, CAST(sum(len(g)) AS BIGINT) AS entities, CAST(sum(coalesce(list_sum([s.start + pos FOR s IN g]), 0)) AS BIGINT) AS starts, CAST(sum(coalesce(list_sum([s."end" + pos FOR s IN g]), 0)) AS BIGINT) AS ends FROM r GROUP BY query""",
        "conversion_status": "SELECT CASE WHEN anthology_id IN (SELECT anthology_id FROM documents WHERE source = 'paper_body' AND trim(text) <> '' AND anthology_id IS NOT NULL) THEN 'converted' ELSE 'failed' END AS status, count(DISTINCT anthology_id) AS papers FROM papers WHERE pdf IS NOT NULL AND anthology_id IS NOT NULL GROUP BY ALL",
        "enhanced_chunks": "SELECT span_row_id, md5(CASE WHEN trim(coalesce(title, '')) <> '' THEN '# ' || trim(title) || chr(10) || chr(10) || chunk ELSE chunk END) AS hash FROM span_rows LEFT JOIN (SELECT anthology_id, min(title) AS title FROM papers WHERE anthology_id IS NOT NULL GROUP BY ALL) ON anthology_id = paper_id",
        "filtered_search": f"""WITH d AS (SELECT span_row_id AS item, {terms.format('chunk')} AS ts FROM span_rows WHERE source = 'gold' AND chunk_index > 2), t AS (SELECT item, unnest(ts) AS term FROM d), p AS (SELECT item, term, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT item, coalesce(len(ts), 0) AS len FROM d),
  s AS (SELECT count(*) AS n, avg(len) AS al FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT query_id, term FROM (SELECT span_row_id AS query_id, unnest({terms.format('query')}) AS term FROM span_rows WHERE span_row_id % 20 = 0)),
  x AS (SELECT query_id, item, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN p USING (term) JOIN l USING (item) JOIN f USING (term), s GROUP BY ALL)
  SELECT query_id, rank, item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM x) WHERE rank <= 5""",
        "results_filled": f"SELECT run_row_id, CAST(rank AS INTEGER) AS rank, document_id, chunk_number, CAST(len(extraction) AS INTEGER) AS spans FROM {_FILLED}",
        "rag_answers": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY run_row_id ORDER BY rank) AS n FROM {_FILLED} WHERE len(extraction) > 0)
  SELECT run_row_id, CAST(count(*) AS INTEGER) AS sources, md5(coalesce(any_value(query), '') || chr(10) || string_agg('[' || n || '] ' || array_to_string([s.text FOR s IN extraction], ' … '), chr(10) ORDER BY n)) AS answer_hash FROM n WHERE n <= 3 GROUP BY run_row_id""",
        "answerable_counts": """SELECT answerable, if_invalid_true, count(*) AS rows FROM (SELECT coalesce(is_relevant, false) OR (coalesce(relevance_label, '') IN ('yes', 'true', '1')) AS answerable,
  coalesce(is_relevant, false) OR coalesce(relevance_label <> 'n', true) AS if_invalid_true FROM span_rows) GROUP BY ALL""",
    }
