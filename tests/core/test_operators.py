import random

from pyspark.sql import functions as F

from spanlake.functions import pytext
from spanlake.functions import text as T
from spanlake.operators import adapters, ann, evaluate, lines, providers, retrieval, silver, tokens

SP = "array<struct<start:int,end:int,text:string>>"
GOLD = f"span_row_id bigint, query string, paper_id string, chunk_index int, chunk string, is_relevant boolean, gold_spans {SP}"
PRED = f"prediction_id bigint, run_name string, query string, question string, paper_id string, chunk_index int, pred_spans {SP}, predicted_texts array<string>, latency_s double, error string, created_at string"


def test_evaluation_of_exact_and_false_predictions(spark):
    gold = spark.createDataFrame([(1, "q", "p", 0, "one two three", True, [(0, 7, "one two")]), (2, "q", "p", 1, "four five", False, []), (3, None, None, None, None, None, None)], GOLD)
    exact = [(1, "a", "q", None, "p", 0, [(0, 7, "one two")], None, 1.0, None, "2"), (2, "a", None, "q", "p", 0, [(0, 3, "one")], None, 9.0, None, "1")]
    false = [(3, "b", "q", None, "p", 0, None, ["one two"], None, "", "1"), (4, "b", "q", None, "p", 1, [(0, 4, "four")], None, 1.0, "timeout", "1")]
    got = {r.run_name: r for r in evaluate.summary(evaluate.evaluated(gold, spark.createDataFrame(exact + false, PRED), spark.createDataFrame(exact + false, PRED))).collect()}
    a, b = got["a"], got["b"]
    assert (a.word_micro_f1, a.iou_micro_f1_50, a.cont_micro_f1_100, a.coverage_100, a.any_overlap_recall, a.over_prediction) == (1, 1, 1, 1, 1, 1)
    assert a.n_examples == 3 and a.n_relevant == 1 and a.errors == 0
    assert b.word_micro_p < 1 and b.word_micro_r == 1 and b.over_prediction == 2 and b.errors == 1
    none = spark.createDataFrame([], PRED)
    assert evaluate.summary(evaluate.evaluated(gold, none, none)).count() == 0


def test_quality_filter(spark):
    config = silver.Quality(deepest=3, captions=False)
    long = "plain words that go on for long enough here"
    rows = [
        (1, 0, [], "gold", None, ""), (2, 1, [], "gold", None, ""), (3, 1, [(0, 1, long)], "retrieved", 9, ""), (4, 1, [(0, 1, long)], "gold", 9, ""), (5, 1, [(0, 1, "few words")], "gold", None, ""), (6, 1, [(0, 1, "w " * 300)], "gold", None, ""),
        (7, 1, [(0, 1, long)], "gold", None, "text\n## References\nx"), (8, 1, [(0, 1, "Table 3: " + long)], "gold", None, ""), (9, 1, [(0, 1, "(Smith, 2001) and (Jones, 2003) say so in text here")], "gold", None, ""), (10, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"n int, label int, s {SP}, source string, r int, c string")
    got = {r.n: r.x for r in df.select("n", silver.drop_reason(F.col("label"), F.col("s"), F.col("source"), F.col("r"), F.col("c"), config).alias("x")).collect()}
    assert got == {1: None, 2: "positive_without_spans", 3: "rank_too_deep", 4: None, 5: "span_too_short", 6: "span_too_long", 7: "reference_section", 8: "caption_like", 9: "citation_dense", 10: None}


def test_group_split(spark):
    df = spark.createDataFrame([(i, f"q{i % 37}" if i % 37 else None) for i in range(400)], "i int, q string")
    got = silver.group_split(df, ["q"], 0.1).collect()
    by = {}
    for r in got:
        assert by.setdefault(r.q, r.split) == r.split
    assert sum(s == "dev" for s in by.values()) == 4 and len(got) == 400
    assert [r.split for r in silver.group_split(df.limit(1), ["q"], 0.0).collect()] == ["dev"]
    assert silver.group_split(df.limit(0), ["q"]).count() == 0


def test_negatives_and_pending(spark):
    df = spark.createDataFrame([("a", i, i < 2) for i in range(9)] + [("b", 20, False), ("c", 30, True)], "query string, item int, label boolean")
    got = silver.negatives(df, "query", "label", "item", 2).collect()
    assert sum(r.label for r in got) == 3 and sum(not r.label and r["query"] == "a" for r in got) == 4 and not [r for r in got if r["query"] == "b"]
    left = silver.pending(spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, k string"), spark.createDataFrame([("x",), (None,)], "k string"), ["k"])
    assert sorted(r.i for r in left.collect()) == [2, 3]


def test_retrieval(spark):
    runs = spark.createDataFrame([(1, "h", "q", "p", 2, [("x", 1), ("p", 1), ("p", 2)]), (2, "h", "r", "p", 9, []), (3, "h", "s", None, None, None)], "run_row_id bigint, search_type string, query string, gold_paper string, gold_chunk int, results array<struct<document_id:string,chunk_number:int>>")
    got = {r.run_row_id: (r.paper_rank, r.chunk_rank) for r in retrieval.gold_ranks(runs).collect()}
    assert got == {1: (2, 3), 2: (None, None), 3: (None, None)}
    table = {r.k: (r.paper_recall, r.chunk_recall) for r in retrieval.recall_table(retrieval.gold_ranks(runs)).collect()}
    assert table[1] == (0, 0) and table[3] == (0.333333, 0.333333)
    arms = spark.createDataFrame([("a", "q", "x", 1), ("a", "q", "y", 2), ("b", "q", "y", 1), ("b", "q", "y", 4), ("z", "q", "w", 1)], "arm string, query string, item string, rank int")
    assert [(r["item"], r["rank"]) for r in retrieval.fused(arms, {"a": 0.5, "b": 0.5}, 2).orderBy("rank").collect()] == [("y", 1), ("x", 2)]
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "item bigint, text string")
    asked = spark.createDataFrame([(7, "Red dog"), (8, None)], "query_id bigint, query_text string")
    assert [r["item"] for r in retrieval.bm25(docs, asked, 5).orderBy("rank").collect()] == [2, 1]
    assert retrieval.bm25(docs.limit(0), asked, 5).count() == 0


def test_dense_search(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(i % 5 == j, 0.4) for j in range(8)]) for i in range(300)] + [(900, [0.0] * 8), (901, None)]
    v = spark.createDataFrame(rows, "item bigint, vec array<float>")
    q = v.where("item % 20 = 0 and vec is not null").select(F.col("item").alias("query_id"), F.col("vec").alias("qvec"))
    exact = {(r.query_id, r["item"]) for r in retrieval.cosine_search(v, q, 10).collect()}
    near = {(r.query_id, r["item"]) for r in ann.search(v, q, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert ann.search(v.limit(0), q, 10).count() == 0 and retrieval.cosine_search(v, q.limit(0), 10).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "one two  three four", [(4, 12, "two  thr")]), (2, "", []), (3, "x", [])], f"i int, c string, s {SP}")
    x = df.withColumn("t", tokens.token_offsets(F.col("c")))
    got = {r.i: r for r in x.select("i", "t", tokens.labels(F.col("t"), F.col("s")).alias("l"), tokens.bio(F.col("t"), F.col("s")).alias("b"), tokens.decoded(F.col("t"), tokens.labels(F.col("t"), F.col("s"))).alias("d")).collect()}
    assert [(a.start, a.end) for a in got[1].t] == [(0, 3), (4, 7), (9, 14), (15, 19)]
    assert got[1].l == [0, 1, 1, 0] and got[1].b == ["O", "B", "I", "O"] and [(a.start, a.end) for a in got[1].d] == [(4, 14)] and got[2].l == []
    w = spark.createDataFrame([(1, list(range(10))), (2, []), (3, [1])], "i int, tok array<int>")
    assert sorted((r.i, r.window, len(r.tokens)) for r in tokens.windows(w, ["i"], "tok", 4, 1).collect()) == [(1, 0, 4), (1, 1, 4), (1, 2, 4), (3, 0, 1)]


def test_text_expressions(spark):
    r = spark.range(1).select(
        T.url_tail(F.lit("https://x.y/a-1//")).alias("a"), T.year_number(F.lit("19x")).alias("b"), T.answer_form(F.lit(" The  cat's, a HAT! ")).alias("c"), T.is_latin(F.lit("Ünï 12")).alias("d"), T.is_latin(F.lit("дом")).alias("e"), T.word_count(F.lit("a b  c")).alias("f"),
    ).first()
    assert tuple(r) == ("a-1", None, "cats hat", True, False, 3)


def test_python_text():
    assert pytext.clean_markdown("  a &amp; b   c") == "  a & b c"
    t = "One is here. Two? \n\nThree without end"
    assert [t[a:b] for a, b in pytext.sentences(t)] == ["One is here.", "Two?", "Three without end"]
    assert pytext.align("A  big\nCat", "a big cat") == (0, 10) and pytext.align("x", "y") is None
    assert pytext.fuzzy_locate("say the quick brown fox now", "the quikc brown fox")[2] >= 0.9 and pytext.fuzzy_locate("abc", "zzzz") is None and pytext.fuzzy_locate("", "a") is None
    assert pytext.first_json('x {"a": "}", "b": {"c": 1}} y') == {"a": "}", "b": {"c": 1}} and pytext.first_json("{bad") is None
    assert pytext.question_types('{"types": ["A", {"name": "B"}, 3]}') == ["A", "B"]
    assert pytext.longest_common("abcdef", "zcdexab") == 3 and pytext.longest_common("", "a") == 0
    text = "# A\n\n" + "word " * 200 + "\n\n# B\n\n" + "x" * 7000
    parts = pytext.chunks(text)
    assert all(b - a <= 5000 for a, b in parts) and parts[1][0] == text.index("# B")


def test_adapters(spark):
    r = adapters.tool_outputs(spark.createDataFrame([("Query: q\n\nTool output:\nab cd ab", ["ab", "ab", "zz", ""], "q", "i1", "grep", 2), ("no marker", [], "q", "i", "t", 0)], "input string, relevant array<string>, query string, instance_id string, tool_type string, chunk_index int"), "tools").collect()
    assert len(r) == 1 and [(s.start, s.end) for s in r[0].spans] == [(0, 2), (6, 8)] and r[0].paper_id == "tools/grep/i1" and r[0].retrieval_rank == 3
    k = adapters.keyed_sentences(spark.createDataFrame([("c", "7", "q", ["A b. C d.", "E f."], [[["0a", "A b."], ["0b", "C d."]], [["1a", "E f."]]], ["0b"])], "config string, id string, question string, documents array<string>, sentences array<array<array<string>>>, relevant array<string>")).orderBy("chunk_index").collect()
    assert [(x.label, [(s.start, s.text) for s in x.spans]) for x in k] == [(1, [(5, "C d.")]), (0, [])]
    m = adapters.tagged_tokens(spark.createDataFrame([("1", ["who"], ["a", "bb", "c", "d"], ["I", "B", "I", "O"])], "id string, question array<string>, context array<string>, label array<string>")).first()
    assert [(s.start, s.end, s.text) for s in m.spans] == [(2, 6, "bb c")]
    c = adapters.paper_chunks(spark.createDataFrame([("p", [("S", ["para one", " "]), (None, ["two"])], ["Fig"])], "id string, sections array<struct<section_name:string,paragraphs:array<string>>>, captions array<string>"))
    assert [x.chunk for x in c.orderBy("chunk_index").collect()] == ["S\n\npara one", "two", "FLOAT SELECTED: Fig"]
    e = adapters.evidence_rows(c, spark.createDataFrame([("p", "q1", "?", ["para one ", "FLOAT SELECTED: Fig", "para one"])], "id string, question_id string, question string, evidence array<string>"))
    assert sorted(x.chunk_index for x in e.where("label = 1").collect()) == [0, 2]


def test_providers(spark):
    class Broken:
        def extract(self, query, chunks):
            raise ValueError("down")

        def complete(self, prompts):
            raise ValueError("down")

    rows = spark.createDataFrame([(1, "where is the treebank", "The treebank is here. Other text."), (2, None, None), (3, "where is the treebank", "nothing")], "row_id bigint, query string, chunk string")
    got = {r.row_id: r for r in providers.extracted(rows, providers.LexicalExtractor()).collect()}
    assert [s.text for s in got[1].pred_spans] == ["The treebank is here."] and got[2].pred_spans == [] and got[3].pred_spans == []
    assert {r.error for r in providers.extracted(rows, Broken()).collect()} == {"ValueError: down"}
    assert {r.error for r in providers.completed(rows, Broken(), "query").collect()} == {"ValueError: down"}
    assert len(providers.sentence_spans(rows, providers.LexicalScorer()).collect()) == 3


def test_lines(spark):
    df = spark.createDataFrame([("r", "a\nb \n\nc", [(0, 3, "")], ["a", "b\nx"])], f"run string, c string, s {SP}, g array<string>").withColumns({"p": lines.touched_lines(F.col("c"), F.col("s")), "q": lines.gold_lines(F.col("g"))})
    assert (df.first().p, df.first().q) == (["a", "b"], ["a", "b", "x"])
    m = lines.measures(df, "p", "q", "c")
    assert lines.summary(df.select("run", *[x.alias(n) for n, x in m.items()]), "run", list(m)).first().line_f1_mean == 0.8


def test_corpus_operators(spark):
    import pytest

    from spanlake.operators import answers, corpus

    tree = spark.createDataFrame([("c", [("v", "B", "2001", [("p1", "t"), ("p2", "u")]), ("w", "B", "2002", [])])], "collection_id string, volumes array<struct<volume_id:string,booktitle:string,year:string,papers:array<struct<paper_id:string,title:string>>>>")
    assert sorted(r.paper_id for r in corpus.flattened_collections(tree).collect()) == ["p1", "p2"]
    chunks = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 1, "z")], "url string, n int, text string")
    assert corpus.exactly_one(chunks, spark.createDataFrame([("a", 1)], "url string, n int"), ["url", "n"]).first().text == "x"
    for bad in (("b", 1), ("c", 1)):
        with pytest.raises(Exception):
            corpus.exactly_one(chunks, spark.createDataFrame([bad], "url string, n int"), ["url", "n"]).collect()
    plan = corpus.conversion_plan(spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), (None, "1")], "anthology_id string, path string"), spark.createDataFrame([("a",), ("b",), ("c",)], "anthology_id string"), spark.createDataFrame([("b",)], "anthology_id string"), ["c"])
    assert [tuple(r) for r in plan.collect()] == [("a", "1")]
    hits = spark.createDataFrame([("q", 1, "u", 0, "d")], "query string, rank int, url string, chunk_number int, document_id string")
    sheet = spark.createDataFrame([("q", 1, "u", 0, "r")], "query string, rank int, url string, chunk_number int, label string")
    assert corpus.annotated_hits(sheet, hits).first().document_id == "d"
    with pytest.raises(Exception):
        corpus.annotated_hits(sheet.withColumn("rank", F.lit(2)), hits).collect()
    a = answers.summary(spark.createDataFrame([(1, ["abc", "zz"], ["abc"]), (2, [], None), (3, None, ["ab"])], "row_id bigint, pred array<string>, gold array<string>")).first()
    assert (a.em_p, a.em_r) == (50.0, 66.67) and a.overlap_r == 66.67
    empty = answers.summary(spark.createDataFrame([], "row_id bigint, pred array<string>, gold array<string>")).first()
    assert empty.em_f1 == 0


def test_search_filters_and_scores(spark):
    assert retrieval.filter_expression('a == "it\'s" and metadata["year"] > 2000 or t LIKE "%x%"') == "a = 'it''s' and `year` > 2000 or t LIKE '%x%'"
    df = spark.createDataFrame([([(0, 4)], [(0, 2), (2, 4)], [0.5, 1.0])], "s array<struct<start:int,end:int>>, t array<struct<start:int,end:int>>, p array<double>")
    r = df.select(tokens.sentence_scores(F.col("s"), F.col("t"), F.col("p")).alias("x"), tokens.thresholded(F.col("t"), F.col("p"), 0.6).alias("y")).first()
    assert r.x == [0.75] and [(a.start, a.end) for a in r.y] == [(2, 4)]
    x = retrieval.sparse_search(retrieval.term_weights(spark.createDataFrame([(1, "a b"), (2, "b b"), (3, None)], "item bigint, text string"), "item", "text"), retrieval.term_weights(spark.createDataFrame([(9, "b")], "query_id bigint, q string"), "query_id", "q"), 5)
    assert [r["item"] for r in x.orderBy("rank").collect()] == [2, 1]


def test_records_and_report(spark):
    from spanlake.plans import report

    df = spark.createDataFrame([("gold", None, None), ("retrieved", True, [(0, 1, "x")]), ("retrieved", False, [(0, 1, "x")])], f"source string, answerable boolean, spans {SP}")
    assert [(r.label, len(r.spans)) for r in silver.records(df).collect()] == [(1, 0), (1, 1), (0, 0)]
    g = silver.generative_examples(spark.createDataFrame([("q", "c", 1, [(0, 1, "x")]), (None, None, 0, None)], f"question string, chunk string, label int, spans {SP}")).collect()
    assert '"answerable":true' in g[0].response and '"spans":[]' in g[1].response
    assert report.table(spark.createDataFrame([(1, 0.5)], "a int, b double")) == "a  b     \n-  ------\n1  0.5000"


def test_answer_overlap_covers_every_run(spark):
    import __spark_entry__ as entry
    from spanlake.operators import answers

    d = "/root/testdata/sf0.001"
    got = {r.run_name: r for r in entry.queries()["answer_overlap"](spark, d).collect()}
    runs = {r.run_name for r in spark.read.parquet(f"{d}/predictions.parquet").select("run_name").distinct().collect()}
    assert len(runs) > 1 and got.keys() == runs
    rows = spark.createDataFrame([(1, "a", ["abc"], ["abc"]), (2, "b", ["zz"], ["abc"]), (3, "b", None, ["ab"])], "row_id bigint, run string, pred array<string>, gold array<string>")
    assert {r.run: r.em_f1 for r in answers.summary(rows, "run").collect()} == {"a": 100.0, "b": 0.0}


def test_sparse_search_makes_no_pairs(spark):
    import random

    rnd = random.Random(8)
    postings = [(i, t, rnd.choice([0.5, 1.0, 1.0, 2.5, -1.0, 0.0])) for i in range(300) for t in ["of", *rnd.sample("abcdefgh", 3)]]
    postings += [(7, "of", 1.0), (8, None, 1.0), (9, "a", None)]  # a term twice, nulls
    asked = [(q, t, rnd.choice([1.0, 1.0, 2.0, -0.5])) for q in range(40) for t in ["of", *rnd.sample("abcdefghx", 2)]]
    asked += [(100 + q, t, v) for q, t, v in asked if q < 3] + [(200, "x", 1.0), (201, None, 1.0)]  # equal queries, one without a hit
    got = retrieval.sparse_search(spark.createDataFrame(postings, "item bigint, term string, weight double"), spark.createDataFrame(asked, "query_id bigint, term string, weight double"), 4, rows=64)
    score = {}
    for q, t, v in asked:
        for i, u, w in postings:
            if t is not None and t == u and w is not None:
                score[q, i] = score.get((q, i), 0) + v * w
    want = {}
    for q, i in sorted(score, key=lambda x: (x[0], -round(score[x], 6), x[1])):
        want.setdefault(q, []).append((i, round(score[q, i], 6)))
    assert {(r.query_id, r.rank, r.item, r.score) for r in got.collect()} == {(q, n + 1, i, s) for q, x in want.items() for n, (i, s) in enumerate(x[:4])}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # items meet queries within tasks, by blocks, and not in a join by term
    assert retrieval.sparse_search(spark.createDataFrame([], "item bigint, term string, weight double"), spark.createDataFrame([], "query_id bigint, term string, weight double"), 4).count() == 0
