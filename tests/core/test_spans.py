import random
import re

import pytest
from pyspark.sql import functions as F

from spanlake.functions import spans as S

SP = "array<struct<start:int,end:int,text:string>>"
WORD = re.compile(r"\S+")


def words_of(chunk, spans):
    out = set()
    for i, m in enumerate(WORD.finditer(chunk)):
        if any(m.start() < e and m.end() > s for s, e in spans):
            out.add(i)
    return out


def likeness(a, b):
    """Shared characters over all characters of two spans, counted one by one."""
    x, y = set(range(*a)), set(range(*b))
    return len(x & y) / len(x | y) if x & y else 0.0


def greedy(pred, gold, t):
    """By definition: if the best pair left reaches t it is a match, and the others match among themselves."""

    def left(p, g):
        best = max((likeness(pred[i], gold[j]), i, j) for i in p for j in g) if p and g else (0.0, 0, 0)
        return 1 + left(p - {best[1]}, g - {best[2]}) if best[0] >= t else 0

    return left(frozenset(range(len(pred))), frozenset(range(len(gold))))


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(8)
    out = []
    for n in range(250):
        chunk = "".join(rnd.choice("ab \n é") for _ in range(rnd.randrange(1, 40)))

        def some():
            return [tuple(sorted((rnd.randrange(len(chunk) + 1), rnd.randrange(len(chunk) + 1)))) for _ in range(rnd.randrange(0, 5))]

        out.append((n, chunk, some(), some()))
    return out


def test_expressions_against_brute_force(spark, cases):
    rows = [(n, c, [(a, b, "") for a, b in p], [(a, b, "") for a, b in g]) for n, c, p, g in cases]
    df = spark.createDataFrame(rows, f"n int, c string, p {SP}, g {SP}")
    p, g = F.col("p"), F.col("g")
    got = df.select(
        "n", S.word_set(F.col("c"), F.filter("p", lambda s: s["end"] > s["start"])).alias("w"), *[S.iou_matches(p, g, t).alias(f"i{int(t * 10)}") for t in (0.3, 0.5, 0.7)], S.touched(g, p).alias("hit"),
        *[S.contained(p, g, t, True).alias(f"c{int(t * 10)}") for t in (0.5, 1.0)], *[S.contained(g, p, t, False).alias(f"d{int(t * 10)}") for t in (0.5, 1.0)], *[S.covered(g, p, t).alias(f"v{int(t * 10)}") for t in (0.5, 1.0)],
        S.merged(p, 2).alias("m"), S.post_processed(p, 3, 1).alias("f"), S.post_processed(p, 3, 1, "merge_first").alias("h"),
    ).collect()

    def merge(spans, gap):
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1] + gap:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(x) for x in out]

    for r in got:
        _, c, p, g = cases[r.n]
        assert set(r.w) == words_of(c, [(a, b) for a, b in p if b > a])
        for t in (0.3, 0.5, 0.7):
            assert r[f"i{int(t * 10)}"] == greedy(p, g, t)
        assert r.hit == sum(any(likeness(x, y) > 0 for x in p) for y in g)
        inter = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0]))
        for t in (0.5, 1.0):
            ok = [(i, j) for i, x in enumerate(p) for j, y in enumerate(g) if x[1] > x[0] and inter(x, y) >= t * (x[1] - x[0])]
            assert r[f"c{int(t * 10)}"] == len({i for i, _ in ok}) and r[f"d{int(t * 10)}"] == len({j for _, j in ok})
            chars = {k for a, b in p for k in range(a, b)}
            assert r[f"v{int(t * 10)}"] == sum(b > a and len(chars & set(range(a, b))) >= t * (b - a) for a, b in g)
        assert [(x.start, x.end) for x in r.m] == merge(p, 2)
        assert [(x.start, x.end) for x in r.f] == merge([x for x in p if x[1] - x[0] >= 3], 1)
        assert [(x.start, x.end) for x in r.h] == [x for x in merge(p, 1) if x[1] - x[0] >= 3]


def test_predicted_spans(spark):
    rows = [
        (1, "Alpha beta", [(0, 5, None), (4, 99, "x"), (3, 3, "y")], ["beta"]), (2, "Alpha beta", [(5, 2, "x")], ["beta"]), (3, "Alpha beta", None, ["BETA", "", None, "gone", "Alpha"]), (4, "", [], None), (5, "Alpha", None, None),
    ]
    df = spark.createDataFrame(rows, f"n int, c string, s {SP}, t array<string>")
    got = {r.n: [(x.start, x.end, x.text) for x in r.x] for r in df.select("n", S.predicted_spans(F.col("s"), F.col("t"), F.col("c")).alias("x")).collect()}
    assert got == {1: [(0, 5, "Alpha")], 2: [], 3: [(6, 10, "BETA"), (0, 5, "Alpha")], 4: [], 5: []}
