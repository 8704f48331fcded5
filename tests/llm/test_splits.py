import random
from collections import Counter

from spanlake.llm.p1_splits import contract, deal, groups

ROWS = "span_row_id bigint, paper_id string, query string, extra string"


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return {x: find(x) for x in list(parent)}


def test_contract_matches_union_find_and_forest_has_no_cycle(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] + [(1000, i) for i in range(1001, 1150)] + [(5, 5), (None, 3)]
    labels, forest = contract(spark.createDataFrame(edges, "u bigint, v bigint"))
    got = {r.node: r.comp for r in labels.collect()}
    want = components([(a, b) for a, b in edges if a is not None and a != b])
    assert set(got) == set(want)
    assert len(set(zip(got.values(), (want[x] for x in got)))) == len(set(got.values())) == len(set(want.values()))
    assert forest.count() == len(got) - len(set(got.values()))


def test_contract_empty(spark):
    labels, forest = contract(spark.createDataFrame([], "u bigint, v bigint"))
    assert labels.count() == forest.count() == 0


def test_groups(spark):
    rows = [
        (1, "A1-2", "What is X?", "a"), (2, "https://site.example/a1-2.pdf", "other", "a"), (3, " a1-2\n", None, None), (4, None, "  what  IS x ?!", None), (5, "None", "zzz", None),
        (6, "", None, None), (7, "b-7", "Zzz.", None), (8, None, None, None), (8, None, None, None), (9, "none", "?", None),
    ]
    papers = spark.createDataFrame([("A1-2",), (None,)], "anthology_id string")
    got = {r.span_row_id: (r.comp, r.group_paper) for r in groups(spark.createDataFrame(rows, ROWS), papers)[0].collect()}
    assert len({got[i][0] for i in (1, 2, 3, 4)}) == 1 and got[4][1] == "A1-2"
    assert got[5] == got[7] and got[5][1] == "b-7"
    assert len({got[i][0] for i in (1, 5, 6, 8, 9)}) == 5 and got[6][1] is None


def test_groups_empty(spark):
    assert groups(spark.createDataFrame([], ROWS), spark.createDataFrame([], "anthology_id string"))[0].count() == 0


def test_deal_keeps_groups_and_shares(spark):
    rnd = random.Random(1)
    rows, i = [], 0
    for g in range(3000):
        for _ in range(2000 if g == 0 else rnd.choice([1, 1, 2, 3, 7])):
            rows.append((i, g, "x"))
            i += 1
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    got = deal(spark.createDataFrame(rows, "span_row_id bigint, comp bigint, split string"), targets).collect()
    assert len(got) == len(rows)
    by_group = {}
    for r in got:
        assert by_group.setdefault(r.comp, r.split) == r.split
    share = Counter(r.split for r in got)
    assert abs(share["train"] / len(rows) - 0.8) < 0.02 and abs(share["test"] / len(rows) - 0.1) < 0.01
    assert deal(spark.createDataFrame([], "span_row_id bigint, comp bigint"), targets).count() == 0
