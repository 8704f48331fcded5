"""Other evidence sets in the silver schema: sentence keys, tool outputs, tagged tokens, sectioned papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPANS = "array<struct<start:int,end:int,text:string>>"


def placed(chunk: Column, texts: Column) -> Column:
    """Spans of texts found one after the other: each searched from the end of the last one found, else from the start; missing ones dropped."""
    init = F.struct(F.lit(1).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        ahead = F.call_function("locate", t, chunk, acc["at"])
        pos = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", t, chunk, F.lit(1)))
        span = F.struct((pos - 1).alias("start"), (pos - 1 + F.length(t)).alias("end"), t.alias("text"))
        return F.when((t == "") | (pos == 0), acc).otherwise(F.struct((pos + F.length(t)).alias("at"), F.array_append(acc["out"], span).alias("out")))

    return F.aggregate(F.filter(texts, lambda t: t.isNotNull()), init, step, lambda acc: acc["out"])


def _record(df: DataFrame, dataset: str, question: Column, paper: Column, gold_paper: Column, index: Column, chunk: Column, spans: Column, keep: list[str] | None = None) -> DataFrame:
    has = F.size(spans) > 0
    return df.select(
        *(keep or []), F.lit(dataset).alias("source_dataset"), question.alias("question"), paper.alias("paper_id"), index.cast("int").alias("chunk_index"), chunk.alias("chunk"), has.cast("int").alias("label"), has.alias("answerable"), spans.alias("spans"),
        F.lit("gold").alias("source"), (index + 1).cast("int").alias("retrieval_rank"), gold_paper.alias("gold_paper"), index.cast("int").alias("gold_chunk"),
    )


def tool_outputs(rows: DataFrame, dataset: str) -> DataFrame:
    """rows(input, relevant array<string>, query, instance_id, tool_type, chunk_index): the chunk is what follows the marker; rows without it or a query are left out."""
    marker = "\n\nTool output:\n"  # fixed value
    at = F.position(F.lit(marker), F.col("input"))
    df = rows.where((at > 0) & (F.coalesce("query", F.lit("")) != "")).withColumn("c", F.substring("input", at + len(marker), F.length("input")))
    df = df.withColumn("s", placed(F.col("c"), F.coalesce("relevant", F.array().cast("array<string>"))))
    i = F.coalesce("chunk_index", F.lit(0))
    name = lambda *p: F.concat_ws("/", F.lit(dataset), *[F.coalesce(x, F.lit("")) for x in p])
    return _record(df, dataset, F.col("query"), name("tool_type", "instance_id"), name("instance_id"), i, F.col("c"), F.col("s"))


def keyed_sentences(rows: DataFrame, dataset: str = "ragbench") -> DataFrame:
    """rows(config, id, question, documents array<string>, sentences array<array<array<string>>>, relevant array<string>): one record per
    distinct document of a question; its spans are its sentences whose key (document number and letters) is relevant."""
    x = rows.select("config", "id", "question", "relevant", "sentences", F.posexplode("documents").alias("i", "doc"))
    x = x.withColumn("own", F.try_element_at("sentences", F.col("i") + 1)).where((F.coalesce("doc", F.lit("")) != "") & (F.size("own") > 0))
    first = F.row_number().over(Window.partitionBy("config", "id", "doc").orderBy("i"))
    x = x.withColumn("n", first).where("n = 1")
    offsets = placed(F.col("doc"), F.transform("own", lambda e: e[1]))
    x = x.withColumn("at", offsets)
    mine = F.filter("own", lambda e: F.array_contains("relevant", e[0]) & (F.regexp_extract(e[0], r"^(\d+)[a-z]+$", 1) == F.col("i").cast("string")))
    texts = F.transform(mine, lambda e: e[1])
    x = x.withColumn("s", F.filter("at", lambda s: F.array_contains(texts, s["text"])))
    base = F.concat_ws("/", F.lit(dataset), "config", "id")
    return _record(x, dataset, F.col("question"), F.concat(base, F.lit("/doc"), F.col("i").cast("string")), base, F.col("i"), F.col("doc"), F.col("s"))


def joined_tokens(tokens: Column) -> Column:
    """struct<text, offsets> of tokens joined by single blanks."""
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda acc, t: F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(t)).alias("end"))).alias("out"))
    return F.struct(F.array_join(tokens, " ").alias("text"), F.aggregate(tokens, init, step, lambda acc: acc["out"]).alias("offsets"))


def bio_spans(tags: Column, offsets: Column, orphan_opens: bool = False) -> Column:
    """Spans (start, end) of B/I runs. An I without a B is ignored, or opens a span (orphan_opens, the scorer's reading)."""
    z = F.arrays_zip(tags.alias("l"), offsets.alias("o"))
    init = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(x["o"]["start"].alias("start"), x["o"]["end"].alias("end"))
        grown = F.array_append(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.struct(F.element_at(acc["out"], -1)["start"].alias("start"), x["o"]["end"].alias("end")))
        opens = x["l"] == "B"
        if orphan_opens:
            opens = opens | ((x["l"] == "I") & ~acc["open"])
        return (
            F.when(opens, F.struct(F.lit(True).alias("open"), F.array_append(acc["out"], span).alias("out")))
            .when((x["l"] == "I") & acc["open"], F.struct(F.lit(True).alias("open"), grown.alias("out")))
            .otherwise(F.struct(F.lit(False).alias("open"), acc["out"].alias("out")))
        )

    return F.aggregate(z, init, step, lambda acc: acc["out"])


def tagged_tokens(rows: DataFrame) -> DataFrame:
    """rows(id, question array<string>, context array<string>, label array<string>) of BIO tags; rows without question or context are left out."""
    x = rows.where("size(question) > 0 and size(context) > 0").withColumn("j", joined_tokens(F.col("context")))
    x = x.withColumn("p", bio_spans(F.coalesce("label", F.array().cast("array<string>")), F.col("j.offsets")))
    spans = F.transform("p", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(F.col("j.text"), s["start"] + 1, s["end"] - s["start"]).alias("text")))
    x = x.withColumn("s", spans)
    paper = F.concat(F.lit("multispanqa/"), F.col("id"))
    return _record(x, "multispanqa", F.array_join("question", " "), paper, paper, F.lit(0), F.col("j.text"), F.col("s"))


def paper_chunks(rows: DataFrame) -> DataFrame:
    """rows(id, sections array<struct<section_name, paragraphs array<string>>>, captions array<string>) as chunks numbered from 0:
    section and paragraph, then every caption as a selected float."""
    named = F.flatten(F.transform(F.coalesce("sections", F.array().cast("array<struct<section_name:string,paragraphs:array<string>>>")), lambda s: F.transform(F.filter(F.coalesce(s["paragraphs"], F.array().cast("array<string>")), lambda p: F.trim(p) != ""), lambda p: F.struct(F.concat_ws("\n\n", F.nullif(F.trim(s["section_name"]), F.lit("")), F.trim(p)).alias("chunk"), F.trim(p).alias("evidence")))))
    floats = F.transform(F.filter(F.coalesce("captions", F.array().cast("array<string>")), lambda c: F.trim(c) != ""), lambda c: F.struct(F.concat(F.lit("FLOAT SELECTED: "), F.trim(c)).alias("chunk"), F.concat(F.lit("FLOAT SELECTED: "), F.trim(c)).alias("evidence")))
    return rows.select("id", F.posexplode(F.concat(named, floats)).alias("chunk_index", "x")).select("id", "chunk_index", "x.chunk", "x.evidence")


def evidence_rows(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """chunks of paper_chunks with questions(id, question_id, question, evidence array<string>): a chunk's spans are the evidence it contains; a text without white space counts once."""
    clean = F.array_distinct(F.filter(F.transform("evidence", lambda x: F.trim(x)), lambda e: e != ""))
    q = questions.select("id", "question_id", "question", clean.alias("wanted"))
    x = chunks.select("id", "chunk_index", "chunk").join(q, "id").withColumn("s", placed(F.col("chunk"), F.filter("wanted", lambda e: F.contains(F.col("chunk"), e))))
    paper = F.concat(F.lit("qasper/"), F.col("id"))
    return _record(x, "qasper", F.col("question"), paper, paper, F.col("chunk_index"), F.col("chunk"), F.col("s"), ["question_id"])
