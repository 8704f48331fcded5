from spanlake.operators import generate as G
from spanlake.operators import records as R
from pyspark.sql import functions as F

SP = "array<struct<start:int,end:int,text:string>>"
TEXT = "Models read text. The parser marks evidence spans. Nothing else matters here."


def test_repaired_spans(spark):
    rows = [(1, "abcabc", [(3, 6, "abc"), (0, 2, "bc"), (9, 12, "zz"), (0, 1, None), (2, 2, "")]), (2, None, [(0, 1, "a")]), (3, "x", None)]
    df = spark.createDataFrame(rows, f"id int, chunk string, s {SP}")
    got = {r.id: [(x.start, x.end, x.text) for x in r.r] for r in df.select("id", R.repaired_spans(F.col("s"), F.col("chunk")).alias("r")).collect()}
    assert got == {1: [(3, 6, "abc"), (1, 3, "bc")], 2: [], 3: []}


def test_answerability_and_language(spark):
    rows = [('{"answerable": false}', False, True), ("Yes, it is", True, True), ("no", False, False), ("hm", False, True), (None, False, True), ("", False, True)]
    df = spark.createDataFrame([(x[0],) for x in rows], "t string").select(R.answerability(F.col("t"), False).alias("a"), R.answerability(F.col("t"), True).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(False, False), (True, True), (False, False), (False, True), (False, True), (False, True)]
    texts = [("the aim of this is that", "en"), ("das ist nicht der Fall", "de"), ("结果表明准确率", "zh"), ("", "other"), (None, None), ("xyz", "other")]
    got = spark.createDataFrame(texts, "t string, l string").select("l", R.language(F.col("t")).alias("g")).collect()
    assert all(r.l == r.g for r in got)


def test_records_of_small_tables(spark):
    rows = [("q", "p", 1, "c", 1, [(0, 1, "c")]), ("q", "p", 1, "c", 1, [(0, 1, "c")]), (None, "p", None, None, 0, None)]
    df = spark.createDataFrame(rows, f"query string, paper_id string, chunk_index int, chunk string, label int, spans {SP}")
    got = {r.query: [(h.relevant, h.extraction) for h in r.results] for r in R.gold_records(df).collect()}
    assert got == {"q": [(1, ["c"]), (1, ["c"])], None: [(0, [])]}
    assert R.gold_records(df.limit(0)).count() == 0
    d = R.defined(df.select(F.col("query").alias("name_")), "name_", spark.createDataFrame([("q", "d"), ("q", "e")], "name string, definition string")).collect()
    assert sorted((r.name_ or "", r.definition or "", r.error or "") for r in d) == [("", "", "unknown type: null"), ("q", "d", ""), ("q", "d", "")]
    lines = R.sheet_lines(spark.createDataFrame([("a", i) for i in range(7)], "q string, i int"), ["q", "i"], 3)
    assert sorted(r.line for r in lines.collect()) == [1, 2, 3, 5, 6, 7, 9]
    ids = R.question_ids(spark.createDataFrame([("q", ["b", "a", None]), ("z", ["x"]), (None, ["y"])], "query string, predicted_texts array<string>"), spark.createDataFrame([(1, "q"), (2, "r")], "question_id int, query string"))
    assert {r.question_id: r.texts for r in ids.collect()} == {1: ["a", "b"], 2: []}


def test_entities(spark):
    rows = [("d", 1, "ab", [(0, 1, "a")]), ("d", 5000, None, None), ("d", 9000, "xyz", [(1, 3, "yz")])]
    got = sorted((r.n, r.at, [(e.start, e.end, e.label) for e in r.entities]) for r in R.entities(spark.createDataFrame(rows, f"doc string, n bigint, chunk string, spans {SP}")).collect())
    text = "ab\n\n\n\nxyz"
    assert got == [(1, 0, [(0, 1, "EVIDENCE")]), (5000, 4, []), (9000, 6, [(7, 9, "EVIDENCE")])] and text[7:9] == "yz"


def test_models_by_stand_ins(spark):
    df = spark.createDataFrame([(1, "which parser marks evidence", TEXT), (2, None, None), (3, "", "")], "row_id bigint, query string, chunk string")
    want = {1: ["The parser marks evidence spans."], 2: [], 3: []}
    spans = lambda x: {r.row_id: [s.text for s in r.pred_spans] for r in x.collect()}
    assert spans(G.pruned_spans(df, G.LexicalPruner())) == want
    assert spans(G.highlighted_spans(df, G.LexicalHighlighter())) == want
    assert spans(G.highlighted_spans(df, G.LexicalHighlighter(), by="spans")) == want
    said = G.Echo([("parser", 'so: {"answerable": true, "spans": ["The PARSER marks", "absent"]}')])
    got = {r.row_id: (r.answerable, [s.text for s in r.pred_spans]) for r in G.annotated_pairs(df, said).collect()}
    assert got == {1: (True, ["The parser marks"]), 2: (False, []), 3: (False, [])}

    class Broken:
        def complete(self, prompts):
            raise RuntimeError("down")

    assert {r.error for r in G.annotated_pairs(df, Broken()).collect()} == {"RuntimeError: down"}
    assert {r.error for r in G.rewritten(df.withColumn("para", F.lit("")), Broken(), "query", "para").collect()} == {"RuntimeError: down", None}
    again = df.withColumn("para", F.when(F.col("row_id") == 1, F.lit(None).cast("string")).otherwise("kept"))
    assert {r.row_id: r.para for r in G.rewritten(again, G.Echo([("parser", "new")]), "query", "para").collect()} == {1: "new", 2: "kept", 3: "kept"}


def test_embedding_and_tagging(spark):
    df = spark.createDataFrame([(1, "which parser marks evidence", "word " * 50 + "parser marks it " + "word " * 60 + "evidence"), (2, "parser", None)], "row_id bigint, query string, chunk string")
    whole = {r.row_id: [(s.start, s.end) for s in r.pred_spans] for r in G.tagged(df, G.WordTagger(), 512, 128).collect()}
    parts = {r.row_id: [(s.start, s.end) for s in r.pred_spans] for r in G.tagged(df, G.WordTagger(), 24, 8).collect()}
    assert whole == parts and len(whole[1]) == 2 and whole[2] == []
    assert {r.row_id: r.pred_spans for r in G.tagged(df, G.WordTagger(), 6, 4).collect()}[1] == []
    e = {r.item: r.vec for r in G.embedded(df, G.HashedEmbedder(16), "row_id", "chunk").collect()}
    assert set(e) == {1} and abs(sum(x * x for x in e[1]) - 1) < 1e-5
    empty = df.limit(0)
    assert G.tagged(empty, G.WordTagger()).count() == G.pruned_spans(empty, G.LexicalPruner()).count() == G.embedded(empty, G.HashedEmbedder(), "row_id", "chunk").count() == 0
