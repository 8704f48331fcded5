import random

from spanlake.llm.automaton import Shapes, Trie, candidates
from spanlake.llm.p3_scans import SHAPES, Reader, misreadings, repaired, vocabulary

WORDS = "the model was trained on a large corpus and the number of captions rose once all other words were kept in each table of results second closer".split()


def reader():
    return Reader({w: 10 for w in [*WORDS, "domain-specific", "domain", "specific"]}, {"second table": 3})


def test_candidates_are_complete():
    rnd = random.Random(2)
    words = {"".join(rnd.choice("ceoimnrlh") for _ in range(rnd.randrange(3, 7))): 1 for _ in range(250)}
    trie, shapes = Trie(words), Shapes(SHAPES)
    for w in rnd.sample(sorted(words), 60):
        places = [(i, a, b) for a, b in SHAPES for i in range(len(w)) if w.startswith(b, i)]
        for edits in [[], *([x] for x in places), *([x, y] for x in places for y in places if x[0] + len(x[2]) <= y[0])]:
            read = w
            for i, a, b in reversed(edits):
                read = read[:i] + a + read[i + len(b) :]
            got = {c: k for c, k, _ in candidates(trie, read, shapes, 2)}
            assert w in got and got[w] <= len(edits)


def test_marks():
    r = reader()
    assert r.marked("the model was trai­\nned on a large corpus")
    assert r.marked("the model was tra-\nined on a large corpus")
    assert r.marked("the m0del was traıned")
    assert r.marked("the model was\n\nPage 12 of 20\n\ntrained on a corpus")
    assert r.marked("the number\n132 | ON LARGE CORPUS\nof captions")
    assert r.marked("the t r a i n e d model")
    for plain in ("the model was trained on domain-\nspecific words", "the model was trained\non a large corpus", "| a | 12 |\n|---|---|\n| model | 7 |", "```\nx1 = m0del\n12\n```", "- one\n- 12 words", "", "## 3 Results\n\nthe model", "the modle was trained"):
        assert not r.marked(plain), plain


def test_repair():
    r = reader()
    text = "the m0del was trai­\nned on a\n\n- 12 -\n\nlarge corpus and the num-\nber of captions r o s e once.\n\nthe 5ccond table of re|sults"
    assert r.repair(text) == "the model was trained on a large corpus and the number of captions rose once.\n\nthe second table of results"
    plain = "the model\nwas trained"
    assert r.repair(plain) == plain


def test_spark(spark):
    base = "the model was trained on a large corpus and the number of captions rose"
    rows = [(i, base, None) for i in range(40)] + [(100, base.replace("model", "m0del").replace("number", "nurnber"), 1), (101, None, 2), (102, "", 3), (103, base + " " + "x" * 200_000, 4)]
    df = spark.createDataFrame(rows, "span_row_id bigint, chunk string, id int")
    assert [(r.id, r.repaired) for r in repaired(df).collect()] == [(100, base)]
    assert repaired(df.limit(0)).count() == 0
    assert "trained" in vocabulary(df, "chunk")[0]


def test_recurring_misreadings_are_no_words(spark):
    base = "the model was trained on a large corpus and the number of captions rose"
    rows = [(i, f"{base} {i}") for i in range(160)]
    rows += [(200 + i, f"{base.replace('number', 'nurnber')} {i}") for i in range(3)]  # one misreading in several chunks
    rows += [(300 + i, base.replace("captions", "captıons").replace("large", "larqe")) for i in range(40)]  # copies of one chunk
    df = spark.createDataFrame(rows, "span_row_id bigint, chunk string")
    words = vocabulary(df, "chunk")[0]
    assert {"number", "large", "corpus"} <= words.keys() and not {"nurnber", "larqe"} & words.keys()
    assert words["corpus"] == 164
    got = {r.id: r.repaired for r in repaired(df).collect()}
    assert got == {200 + i: f"{base} {i}" for i in range(3)} | {300 + i: base for i in range(40)}


def test_misreadings_by_frequency():
    words = {"which": 9000, "vvhich": 20, "table": 8000, "fable": 400, "which-based": 30, "vvhich-based": 10, "tor": 10, "for": 9000}
    assert misreadings(words) == {"vvhich", "vvhich-based"}


def test_misread_capitals():
    r = Reader({w: 10 for w in "the model input based all on graph words".split()})
    assert r.repair("lnput on the modeI\nand 8ased on the 6raph") == "Input on the model and Based on the Graph"
    for plain in ("the McModel", "the wordlist", "the lnpvx", "ALLI MODE"):
        assert not r.marked(plain), plain


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_all_edits():
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("abcden") for _ in range(k))
    words = {word(rnd.randrange(2, 8)): 1 for _ in range(400)}
    trie, none = Trie(words), Shapes([])
    for _ in range(80):
        w = word(rnd.randrange(1, 9))
        for edits in (1, 2):
            got = {c: k for c, k, _ in candidates(trie, w, none, 2 * edits, edits)}
            assert got == {c: 2 * d for c in words if (d := distance(c, w)) <= edits}, w
    # with confusions as well: nothing within the plain distance is lost, and none costs more
    for _ in range(40):
        w = word(6)
        got = {c: k for c, k, _ in candidates(trie, w, Shapes(SHAPES), 4, 2)}
        assert all(got[c] <= 2 * d for c in words if (d := distance(c, w)) <= 2)


def test_named_misreadings():
    words = {w: 50 for w in "the language of a model is natural and all words in it are known by then".split()}
    pairs = {p: 50 for p in ("the language", "language of", "in the", "of the", "by the")}
    r = Reader(words, pairs)
    for read in ("Ianguage", "lauguage", "longuage", "tanguage", "languago", "languaqe", "1anguage", "langxage"):
        text = f"in the {read} of a model"
        assert r.marked(text) and r.repair(text) == "in the language of a model", (read, r.repair(text))
    assert r.repair("all words in tbe language") == "all words in the language"
    long = "a" * 5000
    for plain in ("in the langauge of a model", "in the lnguage of a model", "in the languague of a model", "a tbx of it", "the " + long, "no Languaxe here"):
        assert not r.marked(plain), plain


def test_vocabulary_of_any_size(spark, monkeypatch):
    from spanlake.llm import p3_scans

    base = "the model was trained on a large corpus and the number of captions rose in a naïve domain-specific 数据 table"
    rows = [(i, f"{base} {i}") for i in range(160)]
    rows += [(200 + i, f"{base.replace('number', 'nurnber').replace('domain', 'dornain')} {i}") for i in range(3)]
    rows += [(300, base.replace("table", "tab1e").replace("model", "m0del")), (301, base.replace("captions", "capt1ons").replace("the number", "tbe number")), (302, base.replace("large", "lavge"))]
    df = spark.createDataFrame(rows, "span_row_id bigint, chunk string").cache()
    words, pairs = vocabulary(df, "chunk")
    got = {r.id: r.repaired for r in repaired(df).collect()}
    assert set(got) == {200, 201, 202, 300, 301, 302}
    monkeypatch.setattr(p3_scans, "MOST", 3)  # as if there were more words and pairs than fit
    more, runs = vocabulary(df, "chunk")
    assert dict(more.items()) == words and dict(runs.items()) == pairs and len(more) == len(words)
    assert more["model"] == words["model"] and "nurnber" not in more and "" not in more and runs.get("no such", 0) == 0
    assert {r.id: r.repaired for r in repaired(df).collect()} == got


def test_sorted_trie_as_the_other(spark):
    from spanlake.llm.sorted_table import SortedTrie, sorted_table

    rnd = random.Random(6)
    words = {"".join(rnd.choice("ceoimnéß数r") for _ in range(rnd.randrange(1, 6))): rnd.randrange(1, 99) for _ in range(300)} | {"co-me": 4, "m": 3}
    table = sorted_table(spark.createDataFrame(list(words.items()), "word string, n bigint"), "w")
    plain, shapes = Trie({w: n for w, n in words.items() if len(w) > 2 and w.isalpha()}), Shapes(SHAPES)
    other = SortedTrie(table, visits=7)
    for w in ["come", "rnice", "ceo", "éßc", "数rm", "x", *rnd.sample(sorted(words), 40)]:
        for edits in (0, 1, 2):
            assert sorted(candidates(other, w, shapes, 4, edits)) == sorted(candidates(plain, w, shapes, 4, edits)), w
    assert all(table[w] == n for w, n in words.items()) and "cx" not in table
    empty = sorted_table(spark.createDataFrame([], "word string, n bigint"), "none")
    assert len(empty) == 0 and "a" not in empty and candidates(SortedTrie(empty), "abc", shapes, 4, 1) == []
