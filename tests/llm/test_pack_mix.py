import random
from collections import Counter

import numpy as np

from spanlake.llm.p6_pack import _placed, _sized, best_fit, knapsack, packed, plan
from spanlake.llm.p7_mix import fly, land, mixed
from spanlake.llm.tokens import encoding, vocabulary_path


def test_knapsack_is_exact():
    rnd = random.Random(1)
    for _ in range(30):
        sizes = [rnd.randrange(1, 12) for _ in range(4)]
        values, most = [rnd.random() for _ in sizes], [rnd.randrange(0, 4) for _ in sizes]
        cap = rnd.randrange(5, 30)
        take = knapsack(sizes, np.array(values), most, cap)
        assert sum(s * t for s, t in zip(sizes, take)) <= cap and all(t <= m for t, m in zip(take, most))
        best = max(sum(v * t for v, t in zip(values, c)) for c in np.ndindex(*[m + 1 for m in most]) if sum(s * t for s, t in zip(sizes, c)) <= cap)
        assert abs(sum(v * t for v, t in zip(values, take)) - best) < 1e-9


def test_plan_places_every_item_once():
    rnd = random.Random(2)
    for cap in (64, 300):
        hist = Counter(min(cap, int(rnd.expovariate(1 / 40)) + 1) for _ in range(3000))
        rows, boxes, bound = plan(hist, cap)
        load, seen = Counter(), Counter()
        for length, first, each, m, box, _ in rows:
            seen[length] += each * m
            for i in range(m):
                load[box + i] += length * each
        assert seen == hist and max(load.values()) <= cap and len(load) == boxes
        least = -(-sum(k * v for k, v in hist.items()) // cap)
        assert least <= boxes and bound <= boxes + 1e-6
        alone = sum(m for m, *_ in best_fit(hist, cap))
        assert boxes <= alone
        by, rest = (sum(length * each * m for length, _, each, m, _, b in rows if b == x and length < cap) for x in (True, False))
        assert by >= 0.9 * (by + rest)
    assert plan({}, 10) == ([], 0, 0.0)
    assert plan({7: 3}, 7)[1] == 3


def test_packed(spark):
    texts = ["a few words here", "", None, "word " * 700, "x" * 20_000, "same", "same"] * 3
    df = spark.createDataFrame([(i % 19, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int")
    got = packed(df, [("pack_a", 64), ("pack_b", 512)]).collect()
    encode = encoding(vocabulary_path()).encode_ordinary
    for name, cap in (("pack_a", 64), ("pack_b", 512)):
        mine = [r for r in got if r.limit_name == name]
        load = Counter()
        for r in mine:
            load[r.container_id] += r.tokens
        assert max(load.values()) <= cap
        assert sum(load.values()) == sum(len(encode(t)) for t in texts if t is not None)
        assert all(r.piece == 0 or r.tokens <= cap for r in mine)
    assert packed(df.limit(0), [("pack_a", 64)]).count() == 0
    parts = _sized(df, [("pack_a", 64), ("pack_b", 512)], "doc_id", "text", None)
    sent, joined = _placed(*parts), _placed(*parts, sent=0)
    assert sent.exceptAll(joined).isEmpty() and joined.exceptAll(sent).isEmpty()


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 900, 500), np.full(500, 0.37)
    q = fly(p, size, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    assert set(land(q, size)) <= {0.0, 1.0}
    many = np.mean([fly(np.full(20, 0.3), np.arange(1, 21), np.random.default_rng(s)) for s in range(600)], axis=0)
    assert np.abs(many - 0.3).max() < 0.1


def test_mixed(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(1, 60))), s, "clash") for i, s in enumerate(rnd.choices(["big", "mid", "tiny", None], [60, 30, 5, 5], k=900))] + [(9000, None, "big", ""), (9001, "", "big", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.5), ("m", "mid", 0.3, 2, 0.5), ("m", "tiny", 0.2, 3, 0.5), ("n", "absent", 1.0, 2, 0.1)], "mix_name string, source string, target_share double, max_repeats int, corpus_share double")
    for block in (20_000, 60):
        chosen, records = mixed(df, targets, block=block)
        rows = chosen.collect()
        want = {r["source"]: min(r["wanted"], r["source_tokens"] * r["max_repeats"]) for r in records}
        for s in ("big", "mid", "tiny"):
            assert abs(sum(r.tokens * r.copies for r in rows if r.source == s) - want[s]) < 40
        assert max(r.copies for r in rows if r.source == "tiny") <= 3
        assert max(r.copies for r in rows if r.source == "big") == 1 and not [r for r in rows if r.source == "absent"]
    empty, _ = mixed(df.limit(0), targets)
    assert empty.count() == 0
