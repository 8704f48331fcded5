"""Noise in text from scanned pages.

Method: one pass counts words and pairs of words over all chunks; those in several chunks form a vocabulary trie. A second pass
looks at every chunk: words out of the vocabulary go through a Levenshtein automaton intersected with the trie, which retrieves
all words within its budget of substitutions, insertions and deletions, and of confusions of shapes, which cost half. They are
ranked by the words around, their cost and their frequency. Confusions alone mark a word as misread; any other edit does if it is
a substitution in a word of small letters and the pair with a neighbouring word is known, as it may be a slip of typing or a name else. Running headers, page
numbers and page breaks are then removed, words broken across lines joined and lines reflowed into paragraphs.

The vocabulary holds all words of TWICE distinct chunks and LEAST chunks at least, at any size of the collection. It is computed
over all of them and broadcast. More than MOST words, or pairs, go out as sorted files that executors map into memory and search in
place, so their memory has a bound and no word is left out. Misread forms recur too: a form that the automaton's confusions turn into
a word MANY times as frequent is no word.

Scale: equal chunks are merged before they are counted, which shuffles each distinct text once; the counting pass aggregates
within each task before its shuffle. Nothing else is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import ANY, SHAPE, Shapes, Trie, candidates
from .common import objects, persist_table, read
from .sorted_table import SortedTable, SortedTrie, sorted_table

#: A vocabulary word is in TWICE distinct chunks, and in LEAST chunks with their copies; a reading by more than one confusion, and a pair of
#: words that vouches for one, in READ distinct chunks.
TWICE, LEAST, READ = 2, 3, 10
#: Words, and pairs of words, that are sent to all executors as a dictionary (some 200 MB each); more are sent as sorted files.
MOST = 2_000_000
#: A form that confusions of shapes turn into a word in so many times as many chunks is a misreading of it. On the test data such
#: forms have 110 times and more, pairs of real words under 5.
MANY = 50

WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
HYPHENS = "-­¬‐‑"
BROKEN = re.compile(r"([^\W\d_]+)([-­¬‐‑]) ?\n([^\W\d_]+)")
# Shapes that recognition confuses, as read -> as printed.
SHAPES = [tuple(x.split(">")) for x in "1>l 1>i 0>o 5>s c>e e>c f>t b>h q>g ı>i m>in rn>m rm>nn m>rn n>ri ri>n ii>u ıi>u vv>w ﬁ>fi ﬂ>fl ﬀ>ff fi>ﬁ h>li b>li d>cl r>i cl>d 6>b 8>B 9>g I>l l>I li>h O>0 6>G u>ii w>vv Z>2 2>z 3>e y>v tl>d n>u u>n a>o o>a t>l l>t e>o o>e s>8 S>5 B>8 f>r r>t".split()]
#: Starts of words that were capitals if read so.
CAPITALS = {(a, b.lower()) for a, b in SHAPES if b.isupper()}
ROMAN = r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE = r"(?:[Pp]age ?\d{1,5}(?: (?:of|/) \d{1,5})?|[Pp]{1,2}\. ?\d{1,5}|[-–—] ?\d{1,5} ?[-–—]|\[\d{1,5}\])"
NUMBER = re.compile(rf"^(?:{PAGE}|\d{{1,5}}|[-–—\[]? ?{ROMAN} ?[-–—\]]?)$")
GLUED = re.compile(rf"^{PAGE}(?=[^\W\d_])")
HEADED = re.compile(r"^(?:\d{1,5} ?\| ?(?=[^\W\d_])[^|]{3,}|[^|]{3,}[^\W_\d][.?!…]? ?\| ?\d{1,5}|[^\W\d_][^|]{4,}\S {3,}\d{1,5})$")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W_])")
SPACED_BREAK = re.compile(r"(?<![^\W_])[^\W\d_](?:[ \n][^\W\d_]){3,}(?![^\W_])")
END = re.compile(r"[.!?:;…][\"'”’»)\]]*$")
INSERTED = re.compile(r"(?<=[^\W\d_])[|~](?=[^\W\d_])")
ITEM = re.compile(r"^\s*(?:[-*+•] |\d+[.)] |#{1,6} |>|\||\[\d+\] |\$\$|```)")


def swapped(a: str, b: str) -> bool:
    """Whether two words differ by one swap of neighbours, a slip of typing rather than of reading."""
    d = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(a) == len(b) and len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def budget(word: str, edits: int) -> int:
    """The automaton's budget: a confusion for every three letters and one more, at most four; an edit of any kind counts for two."""
    return min(4, 1 + len(word) // 3) + (edits if len(word) > 3 else 0)


def trie(words: dict[str, int] | SortedTable) -> Trie | SortedTrie:
    """Of the words of three letters and more."""
    return SortedTrie(words) if isinstance(words, SortedTable) else Trie({w: n for w, n in words.items() if len(w) > 2 and w.isalpha()})


class Reader:
    """Marks and repairs chunks by a vocabulary of lower-case words with their numbers of chunks."""

    def __init__(self, vocabulary: dict[str, int] | SortedTable, pairs: dict[str, int] | SortedTable | None = None):
        self.words, self.pairs = vocabulary, pairs or {}
        self.trie = trie(vocabulary)
        self.shapes = Shapes(SHAPES)
        self.memo: dict[str, list[tuple[int, str]]] = {}

    def corrections(self, token: str, edits: int = 0) -> list[tuple[int, str]]:
        """The vocabulary words that a token out of the vocabulary may be a misreading of, with their cost, best first; edits: how many may be
        other than confusions."""
        got = self.memo.get((token, edits))
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[token, edits] = self._corrections(token, edits)
        return got

    def _corrections(self, token: str, edits: int) -> list[tuple[int, str]]:
        low = token.lower()
        if low in self.words or token.isdigit():
            return []
        # capitals other than at the start belong to names and abbreviations, digits only to misreadings if letters are around them
        if any(c.isdigit() for c in token) and sum(c.isalpha() for c in token) < 0.5 * len(token):
            return []
        hits = candidates(self.trie, token, self.shapes, budget(low, edits), edits)
        return [(k, w) for k, _, w in sorted((k, -n, w) for w, k, n in hits if (n >= READ or k <= SHAPE) and not swapped(low, w))]

    def known(self, before: str, w: str, after: str) -> int:
        """In how many chunks a word stands after the one before or before the one after."""
        return self.pairs.get(f"{before} {w}", 0) + self.pairs.get(f"{w} {after}", 0)

    def substitutes(self, token: str) -> list[str]:
        """Words that differ from a small-letter token in one place; names aren't looked at."""
        if len(token) < 5 or not token.isalpha() or not token.islower():
            return []
        return [w for k, w in self.corrections(token, 1) if k == ANY and len(w) == len(token) and sum(a != b for a, b in zip(w, token)) == 1]

    def torn(self, left: str, mark: str, right: str) -> bool:
        """Whether left, mark, line end, right is one word that was broken, rather than a compound that keeps its hyphen."""
        if not left or not right or not right[0].islower() and not (left.isupper() and right.isupper()):
            return False
        if mark != "-":
            return True
        joined, whole, low, rest = (left + right).lower(), f"{left}-{right}".lower(), left.lower(), right.lower()
        if whole in self.words:
            return False
        if joined in self.words:
            return True
        return low not in self.words or rest not in self.words or len(rest) <= 2

    def furniture(self, lines: list[str]) -> set[int]:
        """Numbers of the lines that are page numbers, running headers, or both in one."""
        out, fence = set(), False
        solid = [i for i, x in enumerate(lines) if x.strip()]
        place = {i: k for k, i in enumerate(solid)}
        plain = {}
        for i in solid:
            if lines[i].lstrip().startswith("```"):
                fence = not fence
                plain[i] = False
            else:
                plain[i] = not fence and not ITEM.match(lines[i])
        for i in solid:
            s = lines[i].strip()
            k = place[i]
            before, after = (lines[solid[k - 1]] if k else ""), (lines[solid[k + 1]] if k + 1 < len(solid) else "")
            if "\f" in lines[i]:
                out.add(i)
            elif NUMBER.match(s):
                if not (s.startswith("- ") and s.count("-") == 1) and (plain[i] or s[0] in "[-") and not self._code(lines, i) and not (NUMBER.match(before.strip()) and NUMBER.match(after.strip())):
                    out.add(i)
            elif plain[i] and (HEADED.match(s) or GLUED.match(s)) and len(s) < 140 and "|" != s[0]:
                out.add(i)
        width = max((len(lines[i]) for i in solid if i not in out and not self._alone(lines[i])), default=0)
        for i in solid:
            k, s = place[i], lines[i].strip()
            if i in out or not plain[i] or len(s) > 110 or not s[0].isupper() and not s[0].isdigit() or k + 1 >= len(solid) or END.search(s) and s[-1] != "?":
                continue
            before = next((lines[j] for j in reversed(solid[:k]) if j not in out), "")
            after = next((lines[j] for j in solid[k + 1 :] if j not in out), "")
            near = k and solid[k - 1] in out or solid[k + 1] in out
            shout = sum(c.isupper() for c in s) > 0.8 * sum(c.isalpha() for c in s) and len(s.split()) >= 3
            cut = before and after and not END.search(before.strip()) and after.strip()[0].islower() and not ITEM.match(before) and not ITEM.match(after)
            # a wrapped line of the text would have taken the next word, and isn't wider than the others
            apart = len(s) + 1 + len((after or "x").split()[0]) < 0.85 * width or len(s) > width + 2
            if (near or cut) and (shout or apart and self._title(s)):
                out.add(i)
        return out

    @staticmethod
    def _alone(line: str) -> bool:
        """May be a header, so says nothing about the width of the text."""
        s = line.strip()
        return not END.search(s) and s[:1].isupper() and len(s) < 110 and len(s.split()) >= 3 and s[-1].isalnum() and not re.search(r"[.;,]( |$)", s)

    @staticmethod
    def _title(s: str) -> bool:
        return len(s.split()) >= 3 and not re.search(r"[.;]( |$)", s)

    @staticmethod
    def _code(lines: list[str], i: int) -> bool:
        return sum(x.lstrip().startswith("```") for x in lines[:i]) % 2 == 1

    def prose(self, text: str) -> str:
        """The text without fenced code, tables, formulas and links, whose odd tokens mean nothing."""
        if "```" in text:
            text = re.sub(r"```.*?(?:```|\Z)", " ", text, flags=re.S)
        if "|" in text:
            text = re.sub(r"(?m)^\s*\|.*$", " ", text)
        if "$" in text:
            text = re.sub(r"\$\$.*?\$\$|\$[^$\n]*\$", " ", text, flags=re.S)
        if "`" in text:
            text = re.sub(r"`[^`\n]*`", " ", text)
        return re.sub(r"\S*(?:https?://|www\.)\S*", " ", text) if "://" in text or "www." in text else text

    def misread(self, prose: str) -> bool:
        if SPACED.search(prose):
            return True
        if ("|" in prose or "~" in prose) and INSERTED.search(prose):
            return True
        words, found = self.words, WORD.findall(prose)
        open_: dict[str, list[tuple[str, bool]]] = {}  # tokens that their neighbours decide on
        for token in set(found):
            if token.lower() in words or token.isdigit():
                continue
            for part in token.split("-") if "-" in token else (token,):
                if part.lower() not in words and self._odd(part):
                    if self.corrections(part):
                        if len(part) >= 4:
                            return True
                        open_.setdefault(token, []).append((part, True))
                    elif self.pairs and self.substitutes(part):
                        open_.setdefault(token, []).append((part, False))
        for k, token in enumerate(found if open_ else ()):
            for part, short in open_.get(token, ()):
                before, after = (found[k - 1].lower() if k else ""), (found[k + 1].lower() if k + 1 < len(found) else "")
                options = [w for _, w in self.corrections(part)] if short else self.substitutes(part)
                if any(self.known(before, w, after) >= READ for w in options):
                    return True
        return False

    @staticmethod
    def _odd(part: str) -> bool:
        """Tokens that may be misread words: not names with inner capitals, but for I that stands for l, or numbers with units. Tokens of two
        or three characters need a known neighbour besides."""
        return len(part) >= 2 and (part[1:].replace("I", "l").islower() or part.isupper() and len(part) >= 4 or any(c.isdigit() for c in part) and part[1:] == part[1:].lower())

    def marked(self, text: str) -> bool:
        """Whether the chunk bears traces of scanning."""
        if "\f" in text:
            return True
        if "\n" in text:
            for m in BROKEN.finditer(text):
                if self.torn(*m.groups()):
                    return True
            if self.furniture(text.split("\n")):
                return True
        return self.misread(self.prose(text))

    # repair

    def best(self, token: str, before: str, after: str) -> str:
        """The reading of a token that fits its neighbours best, in the token's case."""
        options = self.corrections(token)
        if len(token) < 4:
            options = [(k, w) for k, w in options if self.known(before, w, after) >= READ]
        if not options and self.pairs and len(token) > 3 and token.isalpha() and (token.islower() or token[1:].islower()):
            # edits of any kind, if the neighbours vouch for the word
            options = [(k, w) for k, w in self.corrections(token, 1) if self.known(before, w, after) >= READ]
        if not options:
            return token
        edits = {w: k for k, w in options}

        def score(w: str) -> tuple:
            near = self.known(before, w, after)
            return (near == 0, edits[w], -near, -self.words.get(w, 0), w)

        w = min(edits, key=score)
        if token[0] == "I" and w[0] == "l" and not token.isupper():
            return w  # a small l, as a capital L looks otherwise
        return w.upper() if token.isupper() and len(token) > 1 else w.capitalize() if token[0].isupper() or (token[0], w[0]) in CAPITALS or token[0].isdigit() and before == "" else w

    def repair(self, text: str) -> str:
        """The chunk as continuous paragraphs; unmarked chunks come back as they are."""
        return self.repaired(text) if self.marked(text) else text

    def repaired(self, text: str) -> str:
        """A marked chunk as continuous paragraphs."""
        lines = text.split("\n")
        gone = self.furniture(lines)
        kept: list[str] = []
        for i, x in enumerate(lines):
            if i in gone:
                if kept and kept[-1] == "":
                    kept.append("\0")  # the paragraph may go on after the page
                else:
                    kept.append("\0")
            else:
                kept.append(x.rstrip(" ") if not x.startswith("```") else x)
        paragraphs: list[list[str]] = [[]]
        fence = seam = False
        for x in kept:
            if x.lstrip().startswith("```"):
                fence = not fence
                paragraphs += [[x]] if fence or len(paragraphs[-1]) == 0 else []
                if not fence:
                    paragraphs[-1].append(x)
                    paragraphs.append([])
                continue
            if fence:
                paragraphs[-1].append(x)
            elif x == "\0":
                seam = True
            elif not x.strip():
                if not seam:
                    paragraphs.append([])
            else:
                if seam:
                    seam = False
                    last = next((p for p in reversed(paragraphs) if p), None)
                    if last is not None and not END.search(last[-1]) and not ITEM.match(x) and not ITEM.match(last[-1]):
                        paragraphs = paragraphs[: max(i for i, p in enumerate(paragraphs) if p) + 1]
                    elif last is not None and paragraphs[-1]:
                        paragraphs.append([])
                if ITEM.match(x) and paragraphs[-1]:
                    paragraphs.append([])
                paragraphs[-1].append(x)
        out = []
        for p in paragraphs:
            if not p:
                continue
            if p[0].startswith("```"):
                out.append("\n".join(p))
                continue
            body = "\n".join(p)
            body = BROKEN.sub(lambda m: m[1] + m[3] if self.torn(*m.groups()) else f"{m[1]}{m[2]}{m[3]}", body)
            if not ITEM.match(body):
                body = SPACED_BREAK.sub(lambda m: re.sub(r"\s", "", m[0]), body)
            body = body if body.lstrip().startswith(("|", "$$")) else re.sub(r"\s*\n\s*", " ", body)
            out.append(self.reread(body))
        joined, table = [], False
        for x in out:
            is_row = x.lstrip().startswith("|")
            joined.append(("\n" if table and is_row else "\n\n" if joined else "") + x)
            table = is_row
        return "".join(joined)

    def reread(self, body: str) -> str:
        if body.lstrip().startswith(("|", "$$", "```")):
            return body
        body = INSERTED.sub("", body)
        found = list(WORD.finditer(body))
        out, at = [], 0
        for k, m in enumerate(found):
            token = m[0]
            if token.lower() in self.words or token.isdigit():
                continue
            parts = token.split("-")
            if not any(p.lower() not in self.words and self._odd(p) for p in parts):
                continue
            before = found[k - 1][0].lower() if k else ""
            after = found[k + 1][0].lower() if k + 1 < len(found) else ""
            new = "-".join(p if p.lower() in self.words or not self._odd(p) else self.best(p, before, after) for p in parts)
            if new != token:
                out += [body[at : m.start()], new]
                at = m.end()
        return "".join(out) + body[at:]


def counts(chunks: DataFrame, text_col: str, pairs: bool) -> DataFrame:
    """(word, n, copies): in how many distinct chunks, and in how many chunks more that equal one of these, each lower-case word, part of a compound, and (pairs) run of two words occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        more: Counter = Counter()

        def rows() -> pd.DataFrame:
            return objects(pd.DataFrame({"word": list(total), "n": pd.Series(list(total.values()), dtype="int64"), "copies": pd.Series([more[w] for w in total], dtype="int64")}))

        for b in batches:
            for t, copies in zip(b["text"], b["copies"]):
                seq = WORD.findall(t.lower())
                own = set(seq)
                if "-" in t:
                    own.update([p for w in own if "-" in w for p in w.split("-")])
                if pairs:
                    own.update([f"{a} {b}" for a, b in zip(seq, seq[1:])])
                total.update(own)
                if copies:
                    more.update(dict.fromkeys(own, copies))
                if len(total) > 2_000_000:
                    yield rows()
                    total, more = Counter(), Counter()
        yield rows()

    texts = chunks.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg((F.count("*") - 1).alias("copies"))
    return texts.mapInPandas(run, "word string, n bigint, copies bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))


def misread_form(w: str, n: int, words: Trie | SortedTrie, shapes: Shapes) -> bool:
    """Whether confusions of shapes turn a word of n chunks into one MANY times as frequent."""
    return len(w) > 2 and w.isalpha() and any(m >= MANY * n and not swapped(w, x) for x, _, m in candidates(words, w, shapes, budget(w, 0)))


def misreadings(words: dict[str, int]) -> set[str]:
    """The words that confusions of shapes turn into one MANY times as frequent, and the compounds with such a part."""
    shapes, known = Shapes(SHAPES), trie(words)
    out = {w for w, n in words.items() if misread_form(w, n, known, shapes)}
    return out | {w for w in words if "-" in w and not out.isdisjoint(w.split("-"))}


def without_misreadings(words: DataFrame) -> DataFrame:
    """words(word, n) without their misreadings, as misreadings() has them, in tasks."""
    name = sorted_table(words, "forms").name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes, known = Shapes(SHAPES), trie(SortedTable(name))
        for b in batches:
            yield objects(b[[misread_form(w, n, known, shapes) for w, n in zip(b["word"], b["n"])]][["word"]])

    out = persist_table(words.mapInPandas(run, "word string"), "misread")
    rest = words.join(out, "word", "left_anti")
    parts = rest.where(F.contains("word", F.lit("-"))).select("word", F.explode(F.split("word", "-")).alias("part"))
    return rest.join(parts.join(out.withColumnRenamed("word", "part"), "part", "left_semi").select("word").distinct(), "word", "left_anti")


#: Words without digits, stray marks and joined letters.
LETTERS = re.compile(r"[^\W\d_ıﬀ-ﬆ]+(?:-[^\W\d_ıﬀ-ﬆ]+)*")


def lettered(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield objects(b[[LETTERS.fullmatch(w) is not None for w in b["word"]]])

    return words.select("word", "n").mapInPandas(run, "word string, n bigint")


def vocabulary(chunks: DataFrame, text_col: str) -> tuple[dict[str, int] | SortedTable, dict[str, int] | SortedTable]:
    """All words in TWICE distinct chunks and LEAST chunks at least, and all runs of two words in READ distinct chunks, with their numbers of
    distinct chunks. Words with digits, single letters, stray marks and misread forms are left out."""
    seen = counts(chunks, text_col, True).where((F.col("n") >= TWICE) & (F.col("n") + F.col("copies") >= LEAST)).select("word", "n")
    seen = seen.withColumn("pair", F.contains("word", F.lit(" "))).where(~F.col("pair") | (F.col("n") >= READ))  # no other pair is asked for
    seen = persist_table(seen, "vocabulary")
    pairs, found = seen.where("pair"), seen.where("not pair")
    in_memory = lambda rows: {r.word: r.n for r in rows.select("word", "n").collect()}
    held = sorted_table(pairs, "pairs") if pairs.count() > MOST else in_memory(pairs)
    if found.count() > MOST:
        return sorted_table(without_misreadings(persist_table(lettered(found), "words")), "words"), held
    words = {w: n for w, n in in_memory(found).items() if LETTERS.fullmatch(w)}
    for w in misreadings(words):
        del words[w]
    return words, held


def _apply(chunks: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """One pass over the chunks after the vocabulary's. how: 'marked' gives the ids of marked chunks, 'repaired' these and their repaired
    texts, 'all' every chunk that isn't null with its text, repaired where it is marked."""
    plain = [x.name if isinstance(x, SortedTable) else x for x in vocabulary(chunks, text_col)]  # broadcasts travel without code
    shared = chunks.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(*[SortedTable(x) if isinstance(x, str) else x for x in shared.value])
        for b in batches:
            hit = pd.Series([r.marked(t) for t in b["text"]], index=b.index, dtype=bool)
            if how != "all":
                b = b[hit]
            text = [(r.repaired(t) if m else t) if how != "marked" else None for t, m in zip(b["text"], hit[b.index])]
            yield pd.DataFrame({"id": b["id"], "text": pd.Series(text, index=b.index, dtype=object), "scanned": hit[b.index]})

    texts = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "id bigint, text string, scanned boolean")


def repaired(chunks: DataFrame, id_col: str = "span_row_id", text_col: str = "chunk") -> DataFrame:
    """(id, repaired) of every chunk with traces of scanning; all others stay as they are and aren't listed. Null and empty chunks have none."""
    return _apply(chunks, id_col, text_col, "repaired").select("id", F.col("text").alias("repaired"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply(read(spark, sf_dir, "span_rows"), "span_row_id", "chunk", "marked").select(F.col("id").alias("span_row_id"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's chunk after repair; null chunks stay null."""
    rows = read(spark, sf_dir, "span_rows").select("span_row_id", "chunk")
    none = rows.where("chunk is null").select("span_row_id", "chunk", F.lit(False).alias("was_scanned"))
    return _apply(rows, "span_row_id", "chunk", "all").select(F.col("id").alias("span_row_id"), F.col("text").alias("chunk"), F.col("scanned").alias("was_scanned")).union(none)
