"""Corpus tables: paper metadata, full texts, histograms, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def last_papers(papers: DataFrame) -> DataFrame:
    """One row per anthology_id: the last by (ingest_date, title, url). Rows without an id are left out."""
    cols = [c for c in papers.columns if c != "anthology_id"]
    order = F.struct(F.coalesce("ingest_date", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")))
    return papers.where("anthology_id is not null").groupBy("anthology_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("anthology_id", "r.*")


def normalised_papers(papers: DataFrame) -> DataFrame:
    """Metadata as published: id from the URL, year as a number, author names, first venue."""
    names = T.author_names(F.col("author"), F.col("author_string"))
    return last_papers(papers).select(
        "anthology_id", T.url_tail(F.col("url")).alias("url_id"), "title", T.year_number(F.col("year")).alias("year"), F.array_join(names, "; ").alias("authors"), F.size(names).alias("n_authors"),
        F.try_element_at("venue", F.lit(1)).alias("venue"), F.coalesce("has_markdown", F.lit(False)).alias("has_markdown"),
    )


def keep_paper(host: str, null_language: bool = True) -> Column:
    """English (or, if null_language, no language given), with authors, and under the host."""
    english = F.col("language") == "English"
    english = english | F.col("language").isNull() if null_language else F.coalesce(english, F.lit(False))
    return english & (F.coalesce(F.size("author"), F.lit(0)) > 0) & F.coalesce(F.contains(F.col("url"), F.lit(host)), F.lit(False))


def silver_rows(span_rows: DataFrame) -> DataFrame:
    """Span rows as silver records: label 1 for relevant rows, spans of positives only."""
    relevant = F.coalesce(F.col("is_relevant"), F.lit(False))
    spans = F.when(relevant, F.col("gold_spans")).otherwise(F.array().cast(span_rows.schema["gold_spans"].dataType))
    return span_rows.select(
        "span_row_id", F.col("query").alias("question"), "paper_id", "chunk_index", "chunk", relevant.cast("int").alias("label"), spans.alias("spans"), "source", "retrieval_rank",
        F.col("gold_paper_id").alias("gold_paper"), F.col("gold_chunk_index").alias("gold_chunk"),
    )


def annotation_action() -> Column:
    """What an annotated hit asks for: relevance_label in '', n, r (with ? for doubt) decides whether gold text is kept, cleared or missing."""
    label = F.coalesce(F.trim("relevance_label"), F.lit(""))
    has = F.coalesce(F.size("gold_spans_raw"), F.lit(0)) > 0
    return (
        F.when(F.contains(label, F.lit("?")), "clear")
        .when(~label.isin("", "n", "r"), "error: unknown label")
        .when((label == "n") & has, "error: gold text on an irrelevant hit")
        .when((label == "r") & ~has, "error: relevant without gold text")
        .when(label == "", "skip")
        .otherwise("keep")
    )


def flattened_collections(collections: DataFrame) -> DataFrame:
    """collections(collection_id, volumes array<struct<volume_id, booktitle, year, papers array<struct<paper_id, title>>>>) as one row per
    paper with its volume's fields; volumes and collections without papers give none."""
    v = collections.select("collection_id", F.explode("volumes").alias("v"))
    return v.select("collection_id", "v.volume_id", "v.booktitle", "v.year", F.explode("v.papers").alias("p")).select("*", "p.*").drop("p")


def exactly_one(chunks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The one row of chunks for every key of wanted; a key without a row or with several fails the job."""
    n = chunks.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in chunks.columns if c not in keys])).alias("_r"))
    j = wanted.select(*keys).join(n, keys, "left")
    bad = F.raise_error(F.concat(F.lit("not exactly one row for "), F.to_json(F.struct(*keys))))
    return j.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(bad.cast("bigint"))).where("_n = 1").select(*keys, "_r.*")


def conversion_plan(files: DataFrame, metadata: DataFrame, outputs: DataFrame, denied: list[str]) -> DataFrame:
    """files(anthology_id, path) that metadata lists, that aren't denied and have no output yet; of several paths the first."""
    first = files.where(F.col("anthology_id").isNotNull() & ~F.col("anthology_id").isin(*denied)).groupBy("anthology_id").agg(F.min("path").alias("path"))
    return first.join(metadata.select("anthology_id"), "anthology_id", "left_semi").join(outputs.select("anthology_id"), "anthology_id", "left_anti")


def annotated_hits(sheet: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of an annotation sheet joined with the stored hits by (query, rank, url, chunk_number); a row without its hit fails the job."""
    keys = ["query", "rank", "url", "chunk_number"]
    j = sheet.join(hits.select(*keys, "document_id").withColumn("found", F.lit(1)), keys, "left")
    lost = F.raise_error(F.concat(F.lit("annotation without a hit: "), F.coalesce(F.to_json(F.struct(*keys)), F.lit("")))).cast("int")
    return j.withColumn("found", F.coalesce("found", lost)).where("found = 1").drop("found")


def same_gold(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of gold keys that only one of two runs has, with the side; empty if both were asked the same."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))
