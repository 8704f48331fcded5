"""The registered queries of the core, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pytext
from ..functions import spans as S
from ..functions import text as T
from ..operators import ann, answers, corpus, evaluate, lines, providers, retrieval, silver, tokens
from ..streaming import ingest

HOST = "anthology.example"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# corpus


def papers_normalised(s: SparkSession, d: str) -> DataFrame:
    return corpus.normalised_papers(table(s, d, "papers"))


def papers_kept(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").where(corpus.keep_paper(HOST)).select("anthology_id", "url", "language")


def papers_fulltext(s: SparkSession, d: str) -> DataFrame:
    """Papers joined with their texts: per volume, papers with a text, documents and characters."""
    p = table(s, d, "papers").where("anthology_id is not null").select("anthology_id").distinct()
    t = table(s, d, "documents").where("text is not null").select("anthology_id", "volume_id", "n_chars")
    return p.join(t, "anthology_id").groupBy("volume_id").agg(F.count_distinct("anthology_id").alias("papers"), F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def papers_without_text(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("text is not null").select("anthology_id").distinct()
    return table(s, d, "papers").where("anthology_id is not null").select("anthology_id").distinct().join(t, "anthology_id", "left_anti")


def document_stats(s: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").groupBy("source", F.lower("lang").alias("lang")).agg(F.count("*").alias("documents"), F.sum(T.word_count(t)).alias("words"), F.max(F.length(t)).alias("longest"))


def unique_texts(s: SparkSession, d: str) -> DataFrame:
    """The first document of each text, in the order of ids."""
    return table(s, d, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def latin_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("anthology_id", "url", F.coalesce(T.is_latin(F.col("title")), F.lit(False)).alias("latin")).distinct()


# span rows


def span_sanity(s: SparkSession, d: str) -> DataFrame:
    """Spans by source: all, out of bounds, and those whose text isn't the slice."""
    x = table(s, d, "span_rows").select("source", "chunk", F.explode("gold_spans").alias("g"))
    bad = (F.col("g.start") < 0) | (F.col("g.end") < F.col("g.start")) | (F.col("g.end") > F.length("chunk"))
    other = ~bad & (S.slice_of(F.col("chunk"), F.col("g.start"), F.col("g.end")) != F.col("g.text"))
    return x.groupBy("source").agg(F.count("*").alias("spans"), F.count_if(bad).alias("out_of_bounds"), F.count_if(other).alias("other_text"))


def gold_alignment(s: SparkSession, d: str) -> DataFrame:
    """Raw gold texts and where they lie in the chunk: exactly, by another case, or not at all."""
    x = table(s, d, "span_rows").select("span_row_id", "chunk", F.posexplode("gold_spans_raw").alias("n", "raw")).where("raw is not null and raw != ''")
    exact = F.position(F.col("raw"), F.col("chunk"))
    folded = F.position(F.lower("raw"), F.lower("chunk"))
    tier = F.when(exact > 0, "exact").when(folded > 0, "case").otherwise("none")
    return x.select("span_row_id", "n", tier.alias("tier"), F.when(exact > 0, exact - 1).when(folded > 0, folded - 1).alias("start"))


def merged_spans(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "predictions").where("pred_spans is not null").select("prediction_id", F.posexplode(S.merged(F.filter("pred_spans", lambda p: p["end"] > p["start"]), 1)).alias("n", "m"))
    return x.select("prediction_id", "n", "m.start", "m.end")


def post_processed_spans(s: SparkSession, d: str) -> DataFrame:
    keep = F.filter("pred_spans", lambda p: p["end"] > p["start"])
    x = table(s, d, "predictions").where("pred_spans is not null").select("prediction_id", S.post_processed(keep, 100, 30).alias("a"), S.post_processed(keep, 100, 30, "merge_first").alias("b"))
    return x.select("prediction_id", F.size("a").alias("filtered_then_merged"), F.size("b").alias("merged_then_filtered"))


def word_ranges(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "span_rows").select("span_row_id", "chunk", F.posexplode("gold_spans").alias("n", "g")).where("g.end > g.start")
    return x.select("span_row_id", "n", S.word_range(F.col("chunk"), F.col("g")).alias("r")).select("span_row_id", "n", F.col("r.lo").alias("first_word"), F.col("r.hi").alias("end_word"))


def _gold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "span_rows").where("split in ('validation', 'test')").select("span_row_id", "query", "paper_id", "chunk_index", "chunk", F.coalesce("is_relevant", F.lit(False)).alias("is_relevant"), "gold_spans")


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "predictions")
    return evaluate.evaluated(_gold(s, d), p, p)


def span_eval_rows(s: SparkSession, d: str) -> DataFrame:
    return _evaluated(s, d).drop("latency", "failed", "is_relevant")


def span_eval_summary(s: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(_evaluated(s, d))


def predictions_last(s: SparkSession, d: str) -> DataFrame:
    return evaluate.last_predictions(table(s, d, "predictions"), ["run_name"]).select("run_name", "query", "paper_id", "chunk_index", "prediction_id")


# retrieval


def gold_ranks(s: SparkSession, d: str) -> DataFrame:
    return retrieval.gold_ranks(table(s, d, "retrieval_runs"))


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return retrieval.recall_table(gold_ranks(s, d))


def _last_run(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The last run of each query of a search type."""
    r = table(s, d, "retrieval_runs").where(F.col("search_type") == kind)
    return r.groupBy("query").agg(F.max_by("results", "run_row_id").alias("results"))


def run_overlap(s: SparkSession, d: str) -> DataFrame:
    o = retrieval.run_overlap(_last_run(s, d, "hybrid"), _last_run(s, d, "dense"), 5)
    return o.agg(F.count("*").alias("queries"), F.sum("shared").alias("shared"), F.sum("either").alias("either"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.try_divide(F.sum("shared"), F.sum("either")), 6).alias("global_iou"))


def run_spearman(s: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_correlation(retrieval.hits(_last_run(s, d, "hybrid"), ["query"]), retrieval.hits(_last_run(s, d, "dense"), ["query"]))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    h = retrieval.hits(_last_run(s, d, "hybrid"), ["query"]).withColumn("arm", F.lit("hybrid")).unionByName(retrieval.hits(_last_run(s, d, "dense"), ["query"]).withColumn("arm", F.lit("dense")))
    arms = h.select("arm", "query", F.concat_ws("#", "document_id", F.col("chunk_number").cast("string")).alias("item"), "rank")
    return retrieval.fused(arms, {"hybrid": 0.7, "dense": 0.3}, 5)


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "span_rows").where("span_row_id % 20 = 0 and query is not null").select(F.col("span_row_id").alias("query_id"), F.col("query").alias("query_text"))


def bm25_search(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "span_rows").select(F.col("span_row_id").alias("item"), F.col("chunk").alias("text"))
    return retrieval.bm25(docs, _asked(s, d), 10)


def cosine_search(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return retrieval.cosine_search(v.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec")), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 10)


def sparse_search(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "span_rows").select(F.col("span_row_id").alias("item"), "chunk")
    return retrieval.sparse_search(retrieval.term_weights(docs, "item", "chunk"), retrieval.term_weights(_asked(s, d), "query_id", "query_text"), 10)


def filtered_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows chosen by a search filter in its own language."""
    rule = retrieval.filter_expression('source == "gold" and metadata["chunk_index"] > 2 and metadata["paper_id"] LIKE "%quill%"')
    return table(s, d, "span_rows").where(rule).select("span_row_id", "source", "chunk_index")


def runs_gold_difference(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "retrieval_runs").select("search_type", "query", "gold_paper", "gold_chunk")
    return corpus.same_gold(r.where("search_type = 'hybrid'"), r.where("search_type = 'dense'"), ["query", "gold_paper", "gold_chunk"])


# silver labels


def silver_records(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the stored runs as records, answerable where a relevant span row has the same query and chunk."""
    c = silver.candidates(table(s, d, "retrieval_runs"), 3).drop("gold_chunk")
    rows = table(s, d, "span_rows").where("is_relevant and query is not null and paper_id is not null").groupBy("query", "paper_id", "chunk_index").agg(F.min_by("gold_spans", "span_row_id").alias("spans"), F.lit(True).alias("answerable"))
    r = silver.records(c.join(rows, ["query", "paper_id", "chunk_index"], "left"))
    return r.select("run_row_id", "source", "paper_id", "chunk_index", "label", F.size("spans").alias("spans"))


def conversion_plan(s: SparkSession, d: str) -> DataFrame:
    """Papers whose file still has to be converted: listed, without text, not denied."""
    p = table(s, d, "papers")
    done = table(s, d, "documents").where("source = 'paper_body' and text is not null").select("anthology_id").distinct()
    return corpus.conversion_plan(p.where("pdf is not null").select("anthology_id", F.col("pdf").alias("path")), p, done, ["1968.tallow-primer.1"])


def generative_examples(s: SparkSession, d: str) -> DataFrame:
    x = silver.generative_examples(corpus.silver_rows(table(s, d, "span_rows")).where("chunk is not null"))
    return x.select(F.md5("prompt").alias("prompt_hash"), F.length("prompt").alias("prompt_chars"), F.contains("response", F.lit('"answerable":true')).alias("answerable"))


def answer_overlap(s: SparkSession, d: str) -> DataFrame:
    """Exact and partial match of every run's answers against gold texts; a missing prediction is an empty one."""
    g = _gold(s, d).where("is_relevant and query is not null and paper_id is not null").select("span_row_id", "query", "paper_id", "chunk_index", F.transform("gold_spans", lambda x: T.answer_form(x["text"])).alias("gold"))
    p, keys = table(s, d, "predictions"), ["query", "paper_id", "chunk_index"]
    g = g.crossJoin(F.broadcast(p.select("run_name").distinct()))  # runs are few
    p = evaluate.last_predictions(p, ["run_name"]).select(F.col("run_name").alias("run"), *[F.col(c).alias(f"p_{c}") for c in keys], F.transform("pred_spans", lambda x: T.answer_form(F.coalesce(x["text"], F.lit("")))).alias("pred"))
    j = g.join(p, [F.col("run_name").eqNullSafe(F.col("run")), *[F.col(c) == F.col(f"p_{c}") for c in keys]], "left")
    return answers.summary(j.withColumnRenamed("span_row_id", "row_id"), "run_name")


def silver_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of every run with their text: the chunk of the first span row that has it."""
    c = silver.candidates(table(s, d, "retrieval_runs"), 3)
    texts = table(s, d, "span_rows").where("paper_id is not null and chunk is not null").groupBy("paper_id", "chunk_index").agg(F.min_by("chunk", "span_row_id").alias("chunk"))
    return c.join(texts, ["paper_id", "chunk_index"], "left").select("run_row_id", "source", "paper_id", "chunk_index", "retrieval_rank", F.length("chunk").alias("chunk_chars"))


def _reasons(s: SparkSession, d: str) -> DataFrame:
    r = corpus.silver_rows(table(s, d, "span_rows"))
    quality = silver.Quality(words=(12, 220), deepest=5)
    c = F.col
    return r.select("span_row_id", "label", "source", "question", silver.drop_reason(c("label"), c("spans"), c("source"), c("retrieval_rank"), c("chunk"), quality).alias("reason"))


def silver_drop_reasons(s: SparkSession, d: str) -> DataFrame:
    return _reasons(s, d).select("span_row_id", "label", "reason")


def silver_filter_summary(s: SparkSession, d: str) -> DataFrame:
    return _reasons(s, d).groupBy("reason").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_distinct("question").alias("questions"))


def group_split(s: SparkSession, d: str) -> DataFrame:
    r = corpus.silver_rows(table(s, d, "span_rows"))
    return silver.group_split(r, ["question", "gold_paper", "gold_chunk"]).select("span_row_id", "split")


def negatives_sampled(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "span_rows").where("query is not null and query != ''").select("query", "span_row_id", F.coalesce("is_relevant", F.lit(False)).alias("label"))
    return silver.negatives(r, "query", "label", "span_row_id", 1).select("span_row_id", "label")


def papers_sampled(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").where(corpus.keep_paper(HOST)).select("anthology_id").distinct()
    return p.withColumn("h", silver.hashed(1337, F.col("anthology_id"))).orderBy("h").limit(50).select("anthology_id")


def chunks_sampled(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "span_rows").where("paper_id is not null").select("paper_id", "chunk_index").distinct()
    return silver.per_group_sample(r, "paper_id", "chunk_index", 2)


def resume_pending(s: SparkSession, d: str) -> DataFrame:
    """Rows of validation and test that the first run hasn't predicted."""
    done = evaluate.last_predictions(table(s, d, "predictions").where("run_name = 'encoder_small'"))
    return silver.pending(_gold(s, d), done, ["query", "paper_id", "chunk_index"]).select("span_row_id")


def sources_tagged(s: SparkSession, d: str) -> DataFrame:
    """Span rows and documents as one tagged table, counted."""
    a = table(s, d, "span_rows").select(F.lit("span_rows").alias("source_dataset"), "source", F.length("chunk").alias("chars"))
    b = table(s, d, "documents").select(F.lit("documents").alias("source_dataset"), "source", F.length("text").alias("chars"))
    return a.unionByName(b).groupBy("source_dataset", "source").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))


def label_rollup(s: SparkSession, d: str) -> DataFrame:
    """Rows and share of positives by source and split, with totals."""
    r = table(s, d, "span_rows").select("source", F.coalesce("split", F.lit("none")).alias("split"), F.coalesce("is_relevant", F.lit(False)).cast("int").alias("y"))
    return r.rollup("source", "split").agg(F.count("*").alias("rows"), F.round(F.avg("y"), 6).alias("positive_share"))


def annotation_actions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "span_rows").select("span_row_id", corpus.annotation_action().alias("action"))


def answer_match(s: SparkSession, d: str) -> DataFrame:
    """Exact match of normalised answer sets of predictions and gold texts, by run."""
    g = _gold(s, d).where("gold_spans is not null").select("query", "paper_id", "chunk_index", F.array_distinct(F.transform("gold_spans", lambda x: T.answer_form(x["text"]))).alias("gold"))
    g = g.where("query is not null and paper_id is not null").groupBy("query", "paper_id", "chunk_index").agg(F.array_distinct(F.flatten(F.collect_list("gold"))).alias("gold"))
    p = evaluate.last_predictions(table(s, d, "predictions"), ["run_name"])
    p = p.withColumn("pred", F.array_distinct(F.transform(F.coalesce("pred_spans", F.array().cast(p.schema["pred_spans"].dataType)), lambda x: T.answer_form(F.coalesce(x["text"], F.lit(""))))))
    j = p.join(g, ["query", "paper_id", "chunk_index"]).withColumn("both", F.size(F.array_intersect("pred", "gold")))
    return j.groupBy("run_name").agg(F.count("*").alias("rows"), F.sum("both").alias("matched"), F.sum(F.size("pred")).alias("predicted"), F.sum(F.size("gold")).alias("expected"))


# tokens


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "span_rows").where("chunk is not null").select("span_row_id", "source", "gold_spans", F.regexp_extract_all("chunk", F.lit(T.WORD), F.lit(0)).alias("words"), "chunk")


def token_windows(s: SparkSession, d: str) -> DataFrame:
    w = tokens.windows(_tokens(s, d), ["span_row_id"], "words", 128, 32)
    return w.select("span_row_id", "window", "first", F.size("tokens").alias("length"), F.md5(F.array_join("tokens", " ")).alias("hash"))


def token_labels(s: SparkSession, d: str) -> DataFrame:
    """Words that gold spans touch, and spans decoded from the labels again."""
    x = _tokens(s, d).where("size(gold_spans) > 0").select("span_row_id", "gold_spans", tokens.token_offsets(F.col("chunk")).alias("t"))
    x = x.withColumn("l", tokens.labels(F.col("t"), F.col("gold_spans")))
    return x.select("span_row_id", F.size("t").alias("words"), F.aggregate("l", F.lit(0), lambda a, b: a + b).alias("positive"), F.size(tokens.decoded(F.col("t"), F.col("l"))).alias("runs"))


def token_scores(s: SparkSession, d: str) -> DataFrame:
    """Token F1 of the stored baseline extraction against gold spans, by source."""
    x = table(s, d, "span_rows").where("chunk is not null and gold_spans is not null").select("source", "gold_spans", "baseline_extraction", tokens.token_offsets(F.col("chunk")).alias("t"))
    base = F.coalesce("baseline_extraction", F.array().cast(x.schema["baseline_extraction"].dataType))
    x = x.select("source", tokens.token_counts(tokens.labels(F.col("t"), base), tokens.labels(F.col("t"), F.col("gold_spans"))).alias("c"))
    return tokens.token_f1(x, ["source"], "c")


# text algorithms in Python


def cleaned_texts(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("before"), pytext.clean_markdown_udf("text").alias("t"))
    return x.select("doc_id", "before", F.length("t").alias("after"))


def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "span_rows").where("chunk is not null").select("source", pytext.sentences_udf("chunk").alias("x"))
    return x.groupBy("source").agg(F.sum(F.size("x")).alias("sentences"), F.max(F.size("x")).alias("most"))


def document_chunks(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(pytext.chunks_udf("text")).alias("chunk_index", "x"))
    return x.select("doc_id", "chunk_index", "x.start", "x.end")


def gold_alignment_full(s: SparkSession, d: str) -> DataFrame:
    """Raw gold texts placed exactly, by case, by white space, or by similarity from 0.9 on."""
    x = table(s, d, "span_rows").select("span_row_id", "chunk", F.posexplode("gold_spans_raw").alias("n", "raw")).where("raw is not null and raw != ''")
    return x.select("span_row_id", "n", pytext.align_udf("chunk", "raw").alias("a")).select("span_row_id", "n", "a.start", "a.end", "a.score")


def extracted_spans(s: SparkSession, d: str) -> DataFrame:
    """Spans of the lexical stand-in extractor for every row."""
    rows = table(s, d, "span_rows").select(F.col("span_row_id").alias("row_id"), "query", "chunk")
    return providers.extracted(rows, providers.LexicalExtractor()).select(F.col("row_id").alias("span_row_id"), "pred_spans", "error")


def scored_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences of relevant rows that reach the scorer's threshold."""
    rows = table(s, d, "span_rows").where("is_relevant").select(F.col("span_row_id").alias("row_id"), "query", "chunk")
    return providers.sentence_spans(rows, providers.LexicalScorer(), 0.5).select(F.col("row_id").alias("span_row_id"), F.size("pred_spans").alias("spans"))


def line_metrics(s: SparkSession, d: str) -> DataFrame:
    """Line measures of the last predictions for relevant rows, by run."""
    none = F.array().cast(S.SPANS)
    p = table(s, d, "predictions")
    rows = _gold(s, d).where("is_relevant and chunk is not null").withColumns({"query": F.coalesce("query", F.lit("")), "paper_id": F.coalesce("paper_id", F.lit(""))})
    j = evaluate.for_every_run(rows, p, p)
    j = j.withColumns({"p": lines.touched_lines(F.col("chunk"), F.coalesce("pred_spans", none)), "g": lines.touched_lines(F.col("chunk"), F.coalesce("gold_spans", none))})
    m = lines.measures(j, "p", "g", "chunk")
    return lines.summary(j.select("run_name", *[c.alias(n) for n, c in m.items()]), "run_name", list(m))


def ivf_search(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return ann.search(v.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec")), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 10)


def ivf_recall(s: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten best that the inverted lists find."""
    exact, near = cosine_search(s, d).select("query_id", "item"), ivf_search(s, d).select("query_id", "item", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "item"], "left").agg(F.count("*").alias("wanted"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def reranked_runs(s: SparkSession, d: str) -> DataFrame:
    """Hits of the last hybrid runs reordered by the words their title shares with the query; hits without a title keep their order behind."""
    r = _last_run(s, d, "hybrid").select("query", F.posexplode("results").alias("pos", "h")).select("query", (F.col("pos") + 1).alias("rank"), "h.document_id", "h.chunk_number", "h.title")
    words = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
    score = F.when(F.col("title").isNotNull(), F.size(F.array_intersect(words(F.col("title")), words(F.col("query")))))
    return retrieval.reranked(r, score, 20, 5).select("query", "new_rank", "rank", "document_id", "chunk_number")


# relational regression and events


def events_hourly(s: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(table(s, d, "events"), "ts", "event_type")


def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    one = F.lit(1)
    c = F.col
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (one - c("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("rows")
    )


def nation_revenue(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    j = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, c("l_orderkey") == c("o_orderkey")).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
    j = j.groupBy("c_nationkey").agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("r"))
    return j.join(table(s, d, "nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"))


def first_per_group(s: SparkSession, d: str) -> DataFrame:
    """The three best-ranked rows of every query."""
    r = table(s, d, "span_rows").where("query is not null and retrieval_rank is not null").select("query", "span_row_id", "retrieval_rank")
    w = Window.partitionBy("query").orderBy("retrieval_rank", "span_row_id")
    return r.withColumn("n", F.row_number().over(w)).where("n <= 3").select("query", "n", "span_row_id")


NAMES = [
    "papers_normalised", "papers_kept", "papers_fulltext", "papers_without_text", "document_stats", "unique_texts", "latin_titles", "span_sanity", "gold_alignment", "merged_spans", "post_processed_spans", "word_ranges",
    "span_eval_rows", "span_eval_summary", "predictions_last", "gold_ranks", "recall_at_k", "run_overlap", "run_spearman", "rrf_fusion", "bm25_search", "cosine_search", "silver_candidates", "silver_drop_reasons", "silver_filter_summary",
    "group_split", "negatives_sampled", "papers_sampled", "chunks_sampled", "resume_pending", "sources_tagged", "label_rollup", "annotation_actions", "answer_match", "token_windows", "token_labels", "token_scores", "cleaned_texts", "sentence_counts", "document_chunks", "gold_alignment_full", "extracted_spans", "scored_sentences", "line_metrics", "ivf_search", "ivf_recall", "reranked_runs",
    "events_hourly", "sparse_search", "filtered_rows", "runs_gold_difference", "silver_records", "conversion_plan", "generative_examples", "answer_overlap", "pricing_summary", "nation_revenue", "first_per_group",
]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
