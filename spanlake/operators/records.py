"""Records between silver, gold and published forms: validated spans, gold records, summaries, exports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S

# Words of running text by which titles and texts show their language.
STOPWORDS = {
    "en": "the of and to in is that for with as are this".split(),
    "de": "der die und das ist nicht mit ein eine für von auf".split(),
    "fr": "le la les des et est une dans que pour qui sur".split(),
    "es": "el los las una que por con para del como más".split(),
    "pt": "o os uma que não com para mais dos são em".split(),
    "cs": "je se na že v jsou pro jak však které při".split(),
    "ru": "и в не на что с как для это по мы".split(),
}
# Answers that mean yes and no.
YES, NO = ("yes", "true", "answerable", "1"), ("no", "false", "unanswerable", "0")


def repaired_spans(spans: Column, chunk: Column) -> Column:
    """Spans whose text is what the chunk has between start and end stay; others move to the first place of their text, or are dropped if it
    doesn't occur. Null texts, and empty ones, are dropped; a null chunk keeps none."""

    def one(s: Column) -> Column:
        good = (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(chunk)) & (F.substring(chunk, s["start"] + 1, s["end"] - s["start"]) == s["text"])
        at = F.instr(chunk, s["text"])
        moved = F.struct((at - 1).alias("start"), (at - 1 + F.length(s["text"])).alias("end"), s["text"].alias("text"))
        return F.when(good, F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).when((F.length(s["text"]) > 0) & (at > 0), moved)

    none = F.array().cast(S.SPANS)
    kept = F.filter(F.transform(F.coalesce(spans, none), one), lambda s: s.isNotNull())
    return F.coalesce(kept, none)


def answerability(text: Column, default: bool) -> Column:
    """Whether an answer says that a question can be answered: the field `answerable` of a JSON object, else its first word; default where neither decides."""
    field = F.lower(F.coalesce(F.get_json_object(text, "$.answerable"), F.get_json_object(text, "$.is_answerable")))
    word = F.lower(F.regexp_extract(text, r"^\W*(\w+)", 1))
    said = F.coalesce(field, word)
    return F.when(said.isin(*YES), True).when(said.isin(*NO), False).otherwise(F.lit(default))


def language(text: Column) -> Column:
    """The language whose running words a text has most of, the first by code among equals; Chinese by its characters; 'other' where there are none, null for null."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    han = F.length(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", ""))

    def count(stop: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stop)))

    scores = F.array(*[F.struct(count(stop).alias("n"), F.lit(-i).alias("o"), F.lit(code).alias("code")) for i, (code, stop) in enumerate(sorted(STOPWORDS.items()))])
    best = F.array_max(scores)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(han * 5 > F.length(text), "zh").when(best["n"] > 0, best["code"]).otherwise("other")


def gold_records(rows: DataFrame) -> DataFrame:
    """rows(query, paper_id, chunk_index, chunk, label, spans) as nested gold records: by query its hits in the order of (paper, chunk index), with
    the texts of the spans of positives. Null queries make one record; a hit that comes twice stays twice. A record is one row by its form; it
    holds keys, hashes and extracted texts only, never chunks."""
    texts = F.when(F.col("label") == 1, F.transform("spans", lambda s: s["text"])).otherwise(F.array().cast("array<string>"))
    hit = F.struct("paper_id", "chunk_index", F.col("label").alias("relevant"), F.coalesce(texts, F.array().cast("array<string>")).alias("extraction"), F.md5("chunk").alias("chunk_hash"))
    return rows.groupBy("query").agg(F.array_sort(F.collect_list(hit)).alias("results"))


def kept_hits(rows: DataFrame, query: str, label: str) -> DataFrame:
    """Annotated hits with a label; queries that have none drop out with them. Null and blank labels are none."""
    return rows.where(F.trim(F.coalesce(label, F.lit(""))) != "").where(F.col(query).isNotNull())


def gold_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals of gold rows: rows, queries, relevant rows, aligned spans and raw texts, and rows whose raw texts aren't all aligned."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    aligned, raw = F.when(F.col("gold_spans").isNull(), 0).otherwise(n("gold_spans")), F.when(F.col("gold_spans_raw").isNull(), 0).otherwise(n("gold_spans_raw"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_distinct("query").alias("queries"), F.count_if(F.coalesce("is_relevant", F.lit(False))).alias("relevant"), F.sum(aligned).alias("spans"), F.sum(raw).alias("raw_texts"), F.count_if(aligned < raw).alias("rows_unaligned"),
    )


def question_ids(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """questions(question_id, query) with the texts predicted for each, all of them listed: predictions(query, predicted_texts) of unknown queries drop
    out, questions without a prediction have an empty list."""
    texts = predictions.where("query is not null").select("query", F.explode(F.coalesce("predicted_texts", F.array().cast("array<string>"))).alias("t")).where("t is not null")
    own = texts.join(questions.select("question_id", "query"), "query").groupBy("question_id").agg(F.array_sort(F.collect_set("t")).alias("texts"))
    return questions.select("question_id").join(own, "question_id", "left").select("question_id", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def defined(rows: DataFrame, key: str, definitions: DataFrame) -> DataFrame:
    """rows with the definition of their type by its exact name, and an error where there is none. definitions(name, definition) is a fixed small
    table; of equal names the first definition."""
    d = definitions.groupBy("name").agg(F.min("definition").alias("definition"))
    j = rows.join(F.broadcast(d), rows[key] == d["name"], "left").drop("name")
    return j.withColumn("error", F.when(F.col("definition").isNull(), F.concat(F.lit("unknown type: "), F.coalesce(key, F.lit("null")))))


def unknown_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values of a column outside a list, with their rows; null counts as unknown."""
    return rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(column).agg(F.count("*").alias("rows"))


def sheet_lines(rows: DataFrame, order: list[str], every: int) -> DataFrame:
    """rows with the number of their line in a sheet that has a blank line after every `every` rows. Counted in blocks of the order's first column,
    so that no task numbers all rows."""
    per = rows.groupBy(order[0]).agg(F.count("*").alias("_c"))
    before = per.select(order[0], (F.sum("_c").over(Window.orderBy(order[0])) - F.col("_c")).alias("_b"))
    n = F.col("_b") + F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:]))
    j = rows.join(before, order[0]).withColumn("n", n)
    return j.withColumn("line", F.col("n") + F.floor((F.col("n") - 1) / every)).drop("_b", "n")


def entities(rows: DataFrame, label: str = "EVIDENCE", block: int = 4096) -> DataFrame:
    """rows(doc, n, chunk, spans) as one text per doc, its chunks in the order of n with a blank line between: (doc, n, at, length, entities) with the place of
    every chunk in that text and its spans as (start, end, label) there. A null chunk is an empty one. Places are running totals over blocks of n, so that
    no task sees a whole hot doc, and no text is moved."""
    short = rows.select("doc", "n", F.length(F.coalesce("chunk", F.lit(""))).alias("length"), F.coalesce("spans", F.array().cast(S.SPANS)).alias("spans"), F.floor(F.col("n") / block).alias("_k"))
    per = short.groupBy(F.col("doc").alias("_d"), F.col("_k").alias("_j")).agg(F.sum(F.col("length") + 2).alias("_s"))
    before = per.select("_d", "_j", (F.sum("_s").over(Window.partitionBy("_d").orderBy("_j")) - F.col("_s")).alias("_b"))
    within = F.sum(F.col("length") + 2).over(Window.partitionBy("doc", "_k").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    j = short.withColumn("_w", F.coalesce(within, F.lit(0))).join(before, (F.col("doc") == F.col("_d")) & (F.col("_k") == F.col("_j")))
    at = F.col("_b") + F.col("_w")
    return j.select("doc", "n", at.alias("at"), "length", F.transform("spans", lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), F.lit(label).alias("label"))).alias("entities"))


def enhanced(chunk: Column, title: Column) -> Column:
    """A chunk as it is indexed: under its paper's title, alone where there is none."""
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(F.lit("# "), F.trim(title), F.lit("\n\n"), chunk)).otherwise(chunk)


def filled_results(runs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Saved results with spans that were extracted afterwards: runs(run_row_id, query, results) and extractions(query, paper_id, chunk_index, spans) to
    (run_row_id, rank, document_id, chunk_number, extraction); a hit without one has an empty list."""
    h = runs.select("run_row_id", "query", F.posexplode("results").alias("pos", "h")).select("run_row_id", "query", (F.col("pos") + 1).alias("rank"), F.col("h.document_id").alias("paper_id"), F.col("h.chunk_number").alias("chunk_index"))
    j = h.join(extractions, ["query", "paper_id", "chunk_index"], "left")
    return j.select("run_row_id", "rank", F.col("paper_id").alias("document_id"), F.col("chunk_index").alias("chunk_number"), F.coalesce("spans", F.array().cast(S.SPANS)).alias("extraction"))


def answers(hits: DataFrame, k: int) -> DataFrame:
    """hits(run_row_id, query, rank, extraction) as answers by a fixed template: the question, and the texts of the spans of the first k hits that have any,
    numbered in their order."""
    some = hits.where(F.size("extraction") > 0)
    w = Window.partitionBy("run_row_id").orderBy("rank")
    first = some.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    text = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.array_join(F.transform("extraction", lambda s: s["text"]), " … "))
    g = first.groupBy("run_row_id", "query").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("p"))
    return g.select("run_row_id", F.concat(F.coalesce("query", F.lit("")), F.lit("\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("answer"), F.size("p").alias("sources"))
