import random

import pytest

from spanlake.llm.p2_cut import boundaries, cuts, indexed, pieces


def check(text, limit, overlap):
    got = cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c == b - overlap and d > b
    assert all(0 <= b - a <= limit for a, b in got)
    return got


def test_cuts_hold_on_random_texts():
    rnd = random.Random(5)
    for _ in range(120):
        text = "".join(rnd.choice(["a", "b", " ", ". ", "\n", "\n\n", "| x |\n", "```\n", "# h\n", "。", "é"]) for _ in range(rnd.randrange(0, 900)))
        limit = rnd.randrange(20, 200)
        check(text, limit, rnd.randrange(0, limit // 2))


def test_cuts_without_boundaries_and_very_long():
    check("x" * 30_000, 5000, 200)
    check("word " * 60_000, 5000, 200)


def test_cuts_prefer_paragraphs():
    text = ("Some words here. " * 20).strip() + "\n\n" + ("More words there. " * 20).strip()
    assert check(text, 400, 0)[0][1] == text.index("\n\n") + 2


def test_optimal_against_brute_force():
    import numpy as np

    # short, as every chain of cuts is tried and every place within words counts at so small a limit
    text = "aa bb. cc\n\nee, gg. ii\nj"
    limit, overlap = 11, 3
    pos, pen = boundaries(text, limit)
    penalty = dict(zip(pos.tolist(), pen.tolist()))
    target = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap))

    def cost(ends):
        total, last = 0.0, overlap
        for e in ends:
            total += penalty[e] + ((e - last) / target - 1) ** 2
            last = e
        return total

    def every(last, start):
        for p in pos.tolist():
            if p > last and p - start <= limit:
                if p == len(text):
                    yield [p]
                elif p > start + overlap or start:
                    for rest in every(p, p - overlap):
                        yield [p, *rest]

    best = min(cost(e) for e in every(0, 0) if e[0] > overlap)
    assert np.isclose(cost([b for _, b in cuts(text, limit, overlap)]), best)


def test_bad_overlap():
    with pytest.raises(ValueError):
        cuts("x" * 50, 10, 10)


def test_pieces_and_indexes(spark):
    long = "One sentence is here. " * 40
    rows = [(1, "P-1", 0, "short"), (2, "p-1", 1, long), (3, "P-1 ", 1, long), (4, "P-1", 2, "next"), (5, None, 0, long), (6, "P-1", None, None), (7, "P-1", 1, "other text"), (2, "p-1", 1, long)]
    df = spark.createDataFrame(rows, "span_row_id bigint, paper_id string, chunk_index int, chunk string")
    first = pieces(df.withColumnRenamed("paper_id", "piece"), "chunk", 300, 20)
    assert first.columns == ["span_row_id", "chunk_index", "piece", "start", "end", "text"] and first.where("length(text) > 300").count() == 0
    got = indexed(df.where("span_row_id != 2 or chunk_index = 1").dropDuplicates(["span_row_id"]), 300, 20).collect()
    at = {}
    for r in got:
        if r.span_row_id in (1, 2, 3, 4, 7):
            assert at.setdefault(r.chunk_index, r.text) == r.text
    assert {r.span_row_id for r in got} == {1, 2, 3, 4, 5, 6, 7}
    assert [r.text for r in got if r.span_row_id == 6] == [None]
    order = {i: min(r.chunk_index for r in got if r.span_row_id == i) for i in (1, 2, 4)}
    assert order[1] < order[2] < order[4]
    assert pieces(df.limit(0), "chunk", 300, 20).count() == 0 and indexed(df.limit(0), 300, 20).count() == 0
