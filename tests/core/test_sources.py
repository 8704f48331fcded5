import json

import pytest
from pyspark.sql import functions as F

from spanlake.sources import readers, schemas, sinks
from spanlake.streaming import ingest


def test_jsonl_round_trip_skips_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q", "paper_id": "p", "chunk_index": 3}\n\n{"question": "r"}\n')
    df = readers.jsonl(spark, str(tmp_path / "a.jsonl"), schemas.SILVER_ROW)
    assert df.count() == 2
    sinks.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(r.question for r in readers.jsonl(spark, str(tmp_path / "out"), schemas.SILVER_ROW).collect()) == ["q", "r"]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.SILVER_ROW, strict=True).collect()


@pytest.mark.parametrize("text", ['[{"query": "a"}, {"query": "b"}]', '{"records": [{"query": "a"}, {"query": "b"}]}', '{"query": "a"}\n\n{"query": "b"}\n'])
def test_prediction_shapes(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    assert sorted(r["query"] for r in readers.predictions(spark, str(tmp_path / "p.json")).collect()) == ["a", "b"]


def test_single_pretty_prediction(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"query": "a", "chunk_index": 1}, indent=2))
    assert [r["query"] for r in readers.predictions(spark, str(tmp_path / "p.json")).collect()] == ["a"]


def test_annotations(spark, tmp_path):
    head = "query,rank,title,url,chunk_number,chunk,relevance_label,extraction_label,gold_extraction\n"
    (tmp_path / "a.csv").write_text(head + 'q,1,t,u,0,"two\nlines",r,p,"one\n\n two "\n,,,,,,,,\n')
    r = readers.annotations(spark, str(tmp_path / "a.csv")).collect()
    assert len(r) == 1 and r[0].gold_extraction == ["one", "two"] and r[0].chunk == "two\nlines"
    (tmp_path / "b.csv").write_text(head + "q,1,t\n")
    with pytest.raises(Exception):
        readers.annotations(spark, str(tmp_path / "b.csv")).collect()


def test_folders(spark, tmp_path):
    (tmp_path / "md/sub").mkdir(parents=True)
    (tmp_path / "md/a.md").write_bytes(b"ok \xff")
    (tmp_path / "md/sub/a.md").write_text("second")
    (tmp_path / "md/sub/b.md").write_text("b")
    got = {r.anthology_id: r.markdown for r in readers.markdown_folder(spark, str(tmp_path / "md")).collect()}
    assert got == {"a": "ok �", "b": "b"}
    (tmp_path / "q").mkdir()
    (tmp_path / "q/P1.jsonl").write_text('{"chunk_index": 0, "chunk": "c", "qa": [{"q_type": "t", "question": "?"}]}\n{"chunk_index": 1, "qa": []}\n')
    assert [(r.paper, r.question) for r in readers.questions_folder(spark, str(tmp_path / "q")).collect()] == [("P1", "?")]
    sinks.export_markdown(readers.markdown_folder(spark, str(tmp_path / "md")), str(tmp_path / "out"))
    assert (tmp_path / "out/b.md").read_text() == "b"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, k string")
    for _ in range(2):
        sinks.append_pending(rows, str(tmp_path / "t"), ["k"], lambda d: d)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    x = spark.createDataFrame([("abcdef", [(1, 2), (4, 6)])], "c string, s array<struct<start:int,end:int>>").select(sinks.highlighted(F.col("c"), F.col("s")).alias("x")).first().x
    assert x == "aBcdEF"
    hits = spark.createDataFrame([("q", 1, "t", "u", 0, "c"), ("q", 2, "t", "u", 1, "d"), ("r", 1, "t", "u", 0, "e")], "query string, rank int, title string, url string, chunk_number int, chunk string")
    sinks.annotation_sheet(hits, str(tmp_path / "sheet"))
    assert sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "sheet").glob("*.csv")) == 5


def test_ingest_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, ids in (("a", [1, 2, 2]), ("b", [2, 3])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"paper_id": f"p{i}"}) for i in ids))
        for _ in range(2):
            ingest.ingest_new(spark, str(tmp_path / "in"), schemas.SILVER_ROW, str(tmp_path / "t"), str(tmp_path / "cp"), ["paper_id"])
    assert sorted(r.paper_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["p1", "p2", "p3"]
    e = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:00:00', 'a'")
    assert sorted(r.rows for r in ingest.windowed_counts(e, "ts", "k").collect()) == [1, 2]


def test_malformed_prediction_lines_are_kept(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"query": "a"}\n{broken\n\n{"query": "b", "error": "e"}\n')
    got = sorted((r["query"] or "", r["error"] or "") for r in readers.predictions(spark, str(tmp_path)).collect())
    assert got == [("", "malformed: {broken"), ("a", ""), ("b", "e")]
    (tmp_path / "q.json").write_text('[{"query": "c"}]')
    (tmp_path / "empty.json").write_text("\n")
    assert readers.predictions(spark, str(tmp_path)).count() == 4


def test_run_summaries_and_limits(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"run_name": "a", "summary": {"f1": 0.5}}')
    (tmp_path / "runs" / "b.json").write_text('{"run_name": "b", "records": []}')
    got = {r.run_name: r.summary for r in readers.run_summaries(spark, str(tmp_path / "runs")).collect()}
    assert got == {"a": {"f1": 0.5}, "b": None}
    spark.range(10).write.parquet(str(tmp_path / "t"))
    assert readers.rows_until(spark, str(tmp_path / "t"), 3).count() == 3 and readers.rows_until(spark, str(tmp_path / "t")).count() == 10
