import random

import numpy as np

from spanlake.llm.fmindex import FMIndex, spread, suffix_array
from spanlake.llm.p4_near import similar_classes
from spanlake.llm.p5_overlap import row_overlaps
from spanlake.llm.sketch import Sketcher


def corpus(seed=4, bases=25):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(bases):
        base = [rnd.choice(words) for _ in range(rnd.randrange(30, 120))]
        texts.append(base)
        for _ in range(rnd.randrange(0, 4)):
            t = list(base)
            for _ in range(rnd.randrange(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(t)
    return [" ".join(t) for t in texts]


def grams(text, n=3):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 60)
    assert suffix_array(t).tolist() == sorted(range(60), key=lambda i: t[i:].tolist())
    texts = [rng.integers(10, 14, n).astype(np.uint64) for n in (30, 0, 3, 50)]
    index, query = FMIndex(texts), rng.integers(10, 15, 40).astype(np.uint64)
    at, lo, hi = index.search(query, 3)
    rows, which = spread(lo, hi)
    doc, off = index.locate(rows)
    got = sorted(zip(at[which].tolist(), doc.tolist(), off.tolist()))
    want = sorted((q, d, i) for q in range(38) for d, t in enumerate(texts) for i in range(len(t) - 2) if (t[i : i + 3] == query[q : q + 3]).all())
    assert got == want
    assert len(FMIndex([]).search(query, 3)[0]) == 0


def test_estimate_is_near_the_similarity(spark):
    from spanlake.llm.sketch import estimate

    s = Sketcher(bands=64)
    a = " ".join(f"x{i}" for i in range(300))
    b = " ".join(f"x{i}" for i in range(60, 360))
    bits = [s.packed(s.minima(s.shingles(t))).view(np.int64).tolist() for t in (a, b)]
    got = spark.createDataFrame([tuple(bits)], "a array<bigint>, b array<bigint>").select(estimate("a", "b", 256).alias("e")).first().e
    assert abs(got - jaccard(grams(a), grams(b))) < 0.12


def test_near_duplicates_against_brute_force(spark):
    texts = corpus() + [None, "", "", "two words", "two words", "Two, words"]
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    members, links = similar_classes(spark.createDataFrame(rows, "row bigint, body string, set_key string, n int"), "row", "body")
    of = {r.id: r.set_key for r in members.collect()}
    linked = {(r.a, r.b) for r in links.collect()}
    g = [grams(t) if t is not None else None for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if g[i] is None or g[j] is None:
                continue
            near = jaccard(g[i], g[j]) >= 0.6 or not g[i] and texts[i] == texts[j]
            same = of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in linked
            assert near == same, (texts[i], texts[j])
    m, k = similar_classes(spark.createDataFrame([], "row bigint, body string"), "row", "body")
    assert m.count() == k.count() == 0


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(9)
    texts = corpus(7)
    queries = ["what is the score of it", "what is the score of it?", "another question altogether", None, " "]
    rows = [(i, t, rnd.choice(queries), rnd.choice(["train", "validation", "test", None]), rnd.choice(["gold", None])) for i, t in enumerate(texts)] + [(900, None, queries[0], "train", "x")]
    df = spark.createDataFrame(rows, "span_row_id bigint, chunk string, query string, split string, source string").withColumn("id", __import__("pyspark").sql.functions.lit("clash"))
    got = {(r.train_id, r.eval_id, r.eval_split, r.source) for r in row_overlaps(df)[0].collect()}
    key = lambda q: (q or "").lower().strip().rstrip(" ?.!")
    tri = lambda q: {q[i : i + 3] for i in range(len(q) - 2)}
    want = set()
    for a in rows:
        for b in rows:
            if a[3] == "train" and b[3] in ("validation", "test") and a[1] and b[1] and key(a[2]) and key(b[2]):
                if jaccard(grams(a[1]), grams(b[1])) >= 0.6 and jaccard(tri(key(a[2])), tri(key(b[2]))) >= 0.6:
                    want.add((a[0], b[0], b[3], b[4]))
    assert got == want and want
    assert row_overlaps(df.limit(0))[0].count() == 0


def test_contained_texts_and_common_phrases(spark):
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    notice = say(60)  # a third of all texts have it
    rows = []
    for i in range(90):
        rows.append((i, " ".join(say(90) + (notice if i % 3 == 0 else [])), "what is it", "train" if i % 2 else "test", "x"))
    small = say(50)
    rows += [(500, " ".join(small), "where is that", "test", "x"), (501, " ".join(say(400) + small + say(300)), "why though", "train", "x")]
    near = say(120)
    edited = [w if k % 12 else rnd.choice(words) for k, w in enumerate(near)]  # an edit every twelfth word
    rows += [(600, " ".join(near), "which one", "train", "x"), (601, " ".join(edited), "which one?", "validation", "x")]
    df = spark.createDataFrame(rows, "span_row_id bigint, chunk string, query string, split string, source string")
    pairs, contained = row_overlaps(df)
    assert {r.eval_id for r in contained.collect()} == {500}
    want = {(600, 601)} if jaccard(grams(" ".join(near)), grams(" ".join(edited))) >= 0.6 else set()
    assert {(r.train_id, r.eval_id) for r in pairs.collect()} == want


def test_index_is_compressed():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 2**62, 4000).astype(np.uint64)[rng.integers(0, 4000, 300)] for _ in range(60)]
    index = FMIndex(texts)
    assert index.nbytes < 4 * index.n


def test_similar_texts_without_a_run_in_common(spark):
    rnd = random.Random(12)
    few = ["yes", "no", "maybe", "both", "none"]
    texts = [" ".join(rnd.choice(few) for _ in range(220)) for _ in range(12)]  # as cells of tables: the same windows in other places
    rows = [(i, t, "what is it", "train" if i % 2 else "test", "x") for i, t in enumerate(texts)]
    g = [grams(t) for t in texts]
    want = {(i, j) for i in range(1, 12, 2) for j in range(0, 12, 2) if jaccard(g[i], g[j]) >= 0.6}
    pieces = [[rnd.choice(few) + str(rnd.randrange(99)) for _ in range(3)] for _ in range(40)]
    long = [w for p in pieces for w in [*p, f"x{rnd.random()}"]]  # all words of the short text, in runs of three
    rows += [(50, " ".join(w for p in pieces for w in p), "where is that", "test", "x"), (51, " ".join(long), "why though", "train", "x")]
    pairs, contained = row_overlaps(spark.createDataFrame(rows, "span_row_id bigint, chunk string, query string, split string, source string"))
    assert {(r.train_id, r.eval_id) for r in pairs.collect()} == want and want
    assert 50 in {r.eval_id for r in contained.collect()}
