"""Garbled text from wrong character encoding.

Method: best-first graph search. The states are spellings of a token, the edges take it to bytes by one encoding and back to
text by another, or unescape character references; visited spellings are hashed. A character-plausibility cost ranks the
queue, and the cheapest spelling reached is the restored one if it is clearly cheaper than what was there. Where no encoding
takes the whole token, its parts are decoded: around lost characters, whose marks stay, and beside genuine ones. Tokens repeat
a lot, so each worker remembers its answers.

A token counts as garbled if the search restores it, or if it holds traces that nothing can restore (replacement characters
in words, control characters of the C1 block).

Where one code page was read as another, every word may look possible by its characters alone. So a first pass counts the pairs
of letters over all documents' words; by these a text's words are weighed under every pair of code pages, and the text counts
as garbled if one pair makes its words far more likely. The same weights choose among the ways that the search found.

The search is complete up to DEPTH steps: a state's edges out of UTF-8 come first, those among code pages when nothing cheaper
is left in the queue; steps may go uphill by UPHILL of the first cost.

Scale: two passes; the first one aggregates within each task and shuffles pairs of letters only, of which there are at most
LETTERS squared. Plain ASCII texts without character references never leave the JVM.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import objects, read

# Encodings that texts get mixed up with.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "gb18030", "cp1250", "iso8859_2", "iso8859_5", "mac_cyrillic")
OTHERS = ("cp1252", "cp1251", "koi8_r", "gb18030", "cp1250", "iso8859_2", "mac_roman", "cp866")
PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
# Characters of running text in the languages of the corpus.
LATIN = "àáâãäåæçčďèéêëěìíîïñňòóôõöøœřšßťùúûüůýÿžćłńśźżąęğışăâțőűđ"
SIGNS = "‘’“”„‚–—…€£§©®±×÷≤≥≠≈°µ·•«»¿¡№†‡™¼½¾¹²³ªº¶→←↑↓∈∑∏√∞∂−′″¢¥‰‹›"
LETTER = re.compile(r"[^\W\d_]")
#: Letters of words that start small, by language; names may mix more.
ALPHABETS = [frozenset(x) for x in ("äöüß", "àâæçéèêëîïôœùûüÿ", "áéíñóúüïç", "ãáàâçéêíóôõúüï", "áčďéěíňóřšťúůýž", "ąćęłńóśźż", "çğıöşüâîû", "ăâîșțşţ", "áéíóöőúüű", "àảãáạăằẳẵắặâầẩẫấậđèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵ")]
AROUND = "".join(SIGNS) + "([{\"'*_"
#: Tokens end at plain white space only: U+0085 and U+00A0 are bytes of garbled characters.
TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
#: A token cheaper than this is left alone; a restored spelling must be cheaper by SAVES and below KEEPS times the old cost.
CALM, SAVES, KEEPS = 2.6, 1.5, 0.62
DEPTH, UPHILL = 4, 0.25
#: Letters that pairs are counted of lie below this code point.
LETTERS = 0x530
#: A text counts as read in a wrong code page if another one saves so much (natural logarithms) in all and by changed word; words
#: below ODD a letter aren't looked at.
GAIN, EACH, ODD = 12.0, 3.0, 4.5
#: Ways that all tokens are tried on, and found tokens (the longest) that choose these.
AGREE = 8
WORD = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"[^\x00-\x7f\w]")
#: Signs that may stand within, after or before letters, or by themselves.
FIT = {"within": "’–", "after": "”“»’‘…–—°²³™®©", "before": "“„«‘’¿¡–—…‹", "alone": SIGNS}
#: The right encoding of a step that decodes only the parts of a token that are UTF-8.
PARTS = "utf-8 in parts"
SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
SEAM = re.compile("([\x00-\x7f]+|\ufffd+)")


def _bytes(text: str, code: str) -> bytes | None:
    """Encode; single-byte code pages pass the control characters that their gaps decode to."""
    try:
        data = text.encode(code)
        # Latin letters of four bytes are none that a Chinese encoding was read as
        return None if code == "gb18030" and any("\x80" <= c < "\u0370" and len(c.encode(code)) == 4 for c in text) else data
    except UnicodeEncodeError:
        if code not in ("cp1252", "cp1250", "cp1251"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(code)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def _text(data: bytes, code: str) -> str | None:
    try:
        return data.decode(code)
    except UnicodeDecodeError:
        return None


class Plausibility:
    """Cost of a token: what its characters and their neighbours would be surprising for in text of the corpus' languages."""

    def __init__(self):
        # the frequent Chinese characters are those of the first level of GB 2312, by rule: lead bytes B0 to D7
        self.common = {bytes((a, b)).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)} - {""}
        self.known: dict[str, tuple[float, str]] = {}
        for c in map(chr, range(128)):
            self.known[c] = (0.0, "A" if c.isupper() else "a" if c.isalpha() else "0")
        for c in LATIN:
            self.known[c] = (0.6, "a")
            if len(c.upper()) == 1:
                self.known[c.upper()] = (0.8, "A")
        for c in "абвгдежзийклмнопрстуфхцчшщъыьэюяё":
            self.known[c], self.known[c.upper()] = (0.05, "r"), (0.1, "R")
        for c in SIGNS:
            self.known[c] = (0.8, "s")
        for c in "’‘“”„«»–—…‹›":
            self.known[c] = (0.5, "q")
        for c in "。、,;:?!“”()《》·…—「」【】、":
            if c not in self.known:
                self.known[c] = (0.05, "p")

    def char(self, c: str) -> tuple[float, str]:
        got = self.known.get(c)
        if got is None:
            got = self.known[c] = self._char(c)
        return got

    def _char(self, c: str) -> tuple[float, str]:
        o = ord(c)
        if o == 0xFFFD or 0x80 <= o <= 0x9F or 0xE000 <= o <= 0xF8FF or o > 0xEFFFF:
            return 6.0, "x"
        if c in self.common:
            return 0.05, "h"
        if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
            return 2.5, "h"
        if 0x0370 <= o <= 0x03FF:
            return 1.0, "g"
        if 0x0400 <= o <= 0x052F:
            return 2.5, "R" if c.isupper() else "r"
        if 0x2500 <= o <= 0x259F:
            return 1.2, "b"
        if 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF60:
            return 0.05, "p"
        if 0x0080 <= o <= 0x024F or 0x1E00 <= o <= 0x1EFF:
            return (1.5, "A" if c.isupper() else "a") if c.isalpha() else (1.2, "s")
        return (2.0, "o") if c.isalpha() else (1.5, "s")

    def frequent(self, token: str) -> float:
        """What frequent Cyrillic and Chinese characters cost by themselves, which adds up in long tokens; ASCII costs nothing."""
        return 0.05 * sum(0 < self.char(c)[0] <= 0.1 for c in token)

    def cost(self, token: str) -> float:
        total, before, prev = 0.0, "0", ""
        letters = {c for c in token if "\xc0" <= c <= "\u024f" and c.islower()}
        if letters and (odd := min(len(letters - a) for a in ALPHABETS)):
            total += odd * (2.5 if token.lstrip(AROUND)[:1].islower() else 0.7)
        for c in token:
            x, kind = self.char(c)
            total += x
            if kind != "0" and before != "0":
                pair = before.lower() + kind.lower()
                if kind in "AR" and before == kind.lower():
                    total += 3.0 if ord(c) > 127 else 0.0  # a capital after a small letter
                elif pair == "ha" and kind == "a":
                    total += 3.0  # a small Latin letter after a Chinese character
                elif pair == "bb":
                    total -= min(x, 1.1)
                elif pair in ("ar", "ra", "ag", "ga", "rg", "gr", "ao", "oa", "ro", "or", "ho", "oh", "rh", "hr"):
                    total += 3.0 if "a" not in pair or "g" not in pair else 1.5  # two scripts in a word
                elif pair in ("as", "rs", "hs", "ab", "rb", "hb") or pair in ("sa", "sr", "ba", "br"):
                    total += 2.5 if c not in "µ°©®™№" and prev not in "µ°©®™№£€¢¥§±¿¡×" else 0.5  # a sign within a word
                elif pair == "qa" and before == "q" and prev in "”–…—“„«" or pair == "aq" and c in "“„«‹":
                    total += 1.0
                elif pair in ("ss", "sq", "qs", "bs", "sb", "bq", "qb"):
                    total += 1.0
            before, prev = kind, c
        return total


class Bytes(dict):
    """For str.translate: each character as the one of its byte in a single-byte encoding, or as U+0100."""

    def __init__(self, code: str):
        super().__init__({i: i for i in range(128)})
        self.code = code

    def __missing__(self, o: int) -> int:
        data = _bytes(chr(o), self.code)
        self[o] = got = 0x100 if data is None else data[0]
        return got


@cache
def page(code: str) -> dict[str, int]:
    """The byte of every character of a code page beyond ASCII; gaps are the control characters."""
    out = {}
    for b in range(128, 256):
        c = _text(bytes([b]), code)
        out[chr(b) if c is None else c] = b
    return out


@cache
def maps() -> dict[tuple[str, str], dict[int, int]]:
    """For str.translate: every character that code page `wrong` gave for a byte as the one that `right` has for it."""
    out = {}
    for wrong in PAGES:
        for right in PAGES:
            back = {b: c for c, b in page(right).items()}
            table = {ord(c): ord(back[b]) for c, b in page(wrong).items()}
            if wrong != right and table not in out.values():
                out[wrong, right] = table
    return out


class Pairs:
    """How surprising a word is by its pairs of letters: minus the logarithm of its probability. Capitals count like small letters."""

    def __init__(self, counts: dict[str, int]):
        self.first, self.second = Counter(), Counter()
        self.counts = counts
        for ab, n in counts.items():
            self.first[ab[0]] += n
            self.second[ab[1]] += n
        self.total = sum(self.second.values())
        self.memo: dict[str, float] = {}

    def step(self, ab: str) -> float:
        got = self.memo.get(ab)
        if got is None:
            alone = (self.second.get(ab[1], 0) + 0.1) / (self.total + 500)
            got = self.memo[ab] = -log((self.counts.get(ab, 0) + 20 * alone) / (self.first.get(ab[0], 0) + 20))
        return got

    def word(self, w: str) -> float:
        low = f" {w.lower()} "
        return sum(map(self.step, map("".join, zip(low, low[1:]))))

    def text(self, t: str) -> float:
        """All words of a token with other than ASCII letters."""
        return sum(self.word(w) for w in WORD.findall(t) if not w.isascii() and max(w) < "\u0530")


class Restorer:
    """Finds and restores garbled texts; pairs: numbers of the pairs of letters, without which texts aren't weighed by code pages."""

    def __init__(self, pairs: dict[str, int] | None = None):
        self.rank = Plausibility()
        self.memo: dict[str, tuple[bool, str]] = {}
        self.tables = {w: Bytes(w) for w in WRONG if w != "gb18030"}
        self.pairs = Pairs(pairs) if pairs else None
        self.odd: dict[str, bool] = {}
        self.gains: dict[str, dict[tuple[str, str], float]] = {}
        self.prices: dict[str, float] = {}

    def surprising(self, word: str) -> bool:
        got = self.odd.get(word)
        if got is None:
            if len(self.odd) > 300_000:
                self.odd.clear()
            got = self.odd[word] = self.pairs.word(word) > ODD * (len(word) + 1)
        return got

    def gain(self, word: str) -> dict[tuple[str, str], float]:
        """What each pair of code pages that changes the word saves in it."""
        got = self.gains.get(word)
        if got is None:
            if len(self.gains) > 20_000:
                self.gains.clear()
            was, got = self.pairs.word(word), {}
            known: dict[str, float] = {}
            for way, table in maps().items():
                new = word.translate(table)
                if new != word:
                    if new not in known:
                        # signs within a word, and capitals after small letters, aren't what a word turns into
                        good = all(map(str.isalpha, new)) and max(new) < "\u0530"
                        known[new] = was - self.pairs.word(new) if good else -was
                    got[way] = known[new]
            self.gains[word] = got
        return got

    def pages(self, text: str) -> tuple[str, str] | None:
        """The (wrong, right) code pages that make the words of the text far more likely, or None."""
        if self.pairs is None:
            return None
        words = {w for w in WORD.findall(text) if not w.isascii() and max(w) < "\u0530"}
        odd = [w for w in words if self.surprising(w)]
        if len(odd) < 2 or sum(self.pairs.word(w) for w in odd) < GAIN * 1.5:
            return None
        hope: Counter = Counter()
        for w in odd:
            hope.update(self.gain(w))
        if not hope or max(hope.values()) < GAIN:
            return None
        saved, changed = Counter(), Counter()
        for w in words:
            g = self.gain(w)
            saved.update(g)
            changed.update(g.keys())
        fit = [(x, way) for way, x in saved.items() if x >= GAIN and x >= EACH * changed[way]]
        return max(fit, key=lambda f: (f[0], f[1]))[1] if fit else None

    def parts(self, text: str, wrong: str) -> str | None:
        """The text with every part decoded that is UTF-8 read as `wrong`, or None if there is none."""
        if wrong == "gb18030":
            return self._gb_parts(text)
        out, at = [], 0
        for m in SEQUENCE.finditer(text.translate(self.tables[wrong])):
            if (new := _text(m[0].encode("latin-1"), "utf-8")) is not None:
                out += [text[at : m.start()], new]
                at = m.end()
        return "".join(out) + text[at:] if at else None

    def _gb_parts(self, text: str) -> str | None:
        """Runs between ASCII and lost characters. Bytes of a character that was lost in part go with it; its mark stays."""
        pieces = SEAM.split(text)
        got: dict[int, str] = {}
        kept = 0
        for i in range(0, len(pieces), 2):
            if run := pieces[i]:
                new = self._gb_run(run, i > 0 and pieces[i - 1][0] == "\ufffd", i + 1 < len(pieces) and pieces[i + 1][0] == "\ufffd")
                if new is None:
                    kept += 1
                else:
                    got[i] = new
        decoded = sum(map(bool, got.values()))
        if not decoded:
            return None
        return "".join(x if i not in got or not got[i] and decoded <= kept else got[i] for i, x in enumerate(pieces))

    def _gb_run(self, run: str, left: bool, right: bool) -> str | None:
        """left, right: whether a character was lost at that end."""
        codes = [c.encode("gb18030", "replace") for c in run]
        data = b"".join(codes)
        skip = 0
        while left and skip < min(3, len(data)) and 0x80 <= data[skip] <= 0xBF:
            skip += 1
        end = len(data)
        for k in range(1, min(4, end - skip + 1) if right else 0):
            if data[-k] >= 0xC0:
                end -= k * (k < (2 if data[-k] < 0xE0 else 3 if data[-k] < 0xF0 else 4))
                break
        if (new := _text(data[skip:end], "utf-8")) is not None:
            return new if self.rank.cost(new) <= self.rank.cost(run) else None
        # genuine characters beside garbled ones: stretches of two characters at least that are clearly cheaper
        ends, n = {0: 0}, 0
        for i, c in enumerate(codes):
            n += len(c)
            ends[n] = i + 1
        out, i, at, hit = [], 0, 0, False
        while i < len(run):
            start = max(at, skip)
            try:
                stop = start + len(data[start:end].decode("utf-8").encode())
            except UnicodeDecodeError as e:
                stop = start + e.start
            while stop > start and (stop not in ends and stop != end or data[stop : stop + 1] and 0x80 <= data[stop] <= 0xBF):
                stop -= 1
            new = _text(data[start:stop], "utf-8") if stop - start >= 6 else None
            j = ends[len(data) if stop == end else stop] if new else i
            if j > i and len(new) > 1 and self.rank.cost(new) <= KEEPS * self.rank.cost(run[i:j]):
                out.append(new)
                hit = True
            else:
                j = i + 1
                out.append(run[i])
            at += sum(map(len, codes[i:j]))
            i = j
        return "".join(out) if hit else None

    def search(self, token: str) -> tuple[float, str, tuple]:
        """(lowest cost, its spelling, the steps that led there); a step is (wrong, right), or () for unescaping."""
        start = self.rank.cost(token)
        best = (start, token, ())
        queue, seen, n = [(start, 0, token, (), False)], {token}, 0
        while queue:
            cost, _, text, steps, late = heapq.heappop(queue)
            coded = any(steps)
            if cost < best[0] - 1e-9:
                best = (cost, text, steps)
            if coded and cost <= max(1.2, 0.12 * start):
                break  # plausible throughout
            if len(steps) >= DEPTH:
                continue
            after = []
            forms: dict[str, bytes] = {}
            if not text.isascii():
                for wrong in WRONG:
                    data = _bytes(text, wrong)
                    if data is not None and data not in forms.values() and (wrong != "gb18030" or "\ufffd" not in text):
                        forms[wrong] = data
            if late:
                for right in OTHERS:
                    for wrong, data in forms.items():
                        if right != wrong and (new := _text(data, right)) is not None:
                            after.append((new, (wrong, right), 3.0 if right == "gb18030" else 0.8))
            else:
                if REFERENCE.search(text):
                    after.append((html.unescape(text), (), 0.0))
                after += [(new, (w, "utf-8"), 0.0) for w, data in forms.items() if (new := _text(data, "utf-8")) is not None]
                sure = any(self.rank.cost(new) <= KEEPS * cost for new, step, _ in after if step)  # nothing decodes as UTF-8 by chance
                if not text.isascii() and not sure:
                    marks = 6.0 * text.count("\ufffd")
                    codes = [x[0] for x in steps if x and x[1] == PARTS][-1:] or WRONG  # parts are all of one encoding
                    parts = [(new, (w, PARTS), 0.0) for w in codes if (new := self.parts(text, w)) is not None]
                    after += (parts := [x for x in parts if self.rank.cost(x[0]) - marks <= KEEPS * (cost - marks)])
                    # the edges among code pages, once nothing cheaper is left; what decodes as UTF-8 in parts isn't of one code page
                    if forms and not parts and not any(x and x[1] == PARTS for x in steps):
                        n += 1
                        heapq.heappush(queue, (cost, n, text, steps, True))
            for new, step, extra in after:
                if new not in seen and not any(x < " " and x not in "\t\n\r" for x in new):
                    seen.add(new)
                    n += 1
                    k = self.rank.cost(new) + extra
                    if k < cost or not step or step[1] == "utf-8" and k < start * (1 + UPHILL):
                        heapq.heappush(queue, (k, n, new, (*steps, step), False))
        return best

    def token(self, token: str) -> tuple[bool, str, tuple]:
        """(garbled, restored spelling, steps)."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[token] = self._token(token)
        return got

    def _token(self, token: str) -> tuple[bool, str, tuple]:
        plain = html.unescape(token) if "&" in token else token
        start = self.rank.cost(plain)
        lost = any(c == "\ufffd" or "\x80" <= c <= "\x9f" and (c != "\x85" or LETTER.search(plain)) for c in plain)
        if not lost and start < CALM + self.rank.frequent(plain) - 1e-9:
            return False, token, ()
        cost, text, steps = self.search(plain)
        if plain != token:
            steps = ((), *steps)
        marks = 6.0 * plain.count("\ufffd")  # which no step removes
        if any(steps) and cost <= start - SAVES and cost - marks <= KEEPS * (start - marks):
            return True, text, steps
        return lost, token, ()

    def follow(self, token: str, steps: tuple) -> str | None:
        """The token after the given steps, if they lead through."""
        for step in steps:
            if step and step[1] == PARTS:
                token = self.parts(token, step[0])
                if token is None:
                    return None
            elif step:
                data = _bytes(token, step[0])
                token = None if data is None else _text(data, step[1])
                if token is None:
                    return None
            else:
                token = html.unescape(token)
        return token

    def suspects(self, text: str) -> list[str]:
        return [w for w in TOKEN.findall(text) if not w.isascii() or "&" in w and REFERENCE.search(w)]

    def garbled(self, text: str) -> bool:
        return any(self.token(w)[0] for w in dict.fromkeys(self.suspects(text))) or self.pages(text) is not None

    def price(self, token: str) -> float:
        """What ranks ways: the plausibility of the characters, and that of the pairs of letters where these are known."""
        if not self.pairs:
            return self.rank.cost(token)
        got = self.prices.get(token)
        if got is None:
            if len(self.prices) > 300_000:
                self.prices.clear()
            got = self.prices[token] = self._price(token)
        return got

    def _price(self, token: str) -> float:
        signs = 0.0
        for m in INNER.finditer(token):
            i = m.start()
            left, right = token[i - 1 : i].isalpha(), token[i + 1 : i + 2].isalpha()
            where = "within" if left and right else "after" if left else "before" if right else "alone"
            signs += 0.0 if m[0] in FIT[where] else 8.0 if where == "within" else 4.0
        return self.rank.cost(token) + 0.3 * self.pairs.text(token) + signs

    def ways(self, found: dict, text: str) -> list[tuple]:
        """The ways that restore the found tokens, the one that suits all tokens of the text best first."""
        ways: dict[tuple, float] = dict.fromkeys((steps for _, _, steps in found.values() if steps), 0.0)
        single = [x for x in ways if x[-1] and x[-1][1] not in ("utf-8", PARTS)]
        tokens = list(found)
        if self.pairs and (single or not ways):
            if (best := self.pages(text)) is not None:
                ways[(best,)] = 0.0
            # all pairs of code pages by the found tokens first, the best by all tokens then
            more = {(*x[:-1], way): 0.0 for x in single for way in maps()}
            for w in sorted(tokens, key=lambda w: (-len(w), w))[:AGREE]:
                for way in more:
                    new = self.follow(w, way)
                    more[way] += self.price(w if new is None else new)
            ways.update(dict.fromkeys(sorted(more, key=lambda x: (more[x], len(x), x))[:AGREE], 0.0))
            tokens = [w for w in dict.fromkeys(TOKEN.findall(text)) if not w.isascii()]
        if len(ways) > 1:
            for way in ways:
                for w in tokens:
                    new = self.follow(w, way)
                    ways[way] += self.price(w if new is None else new)
        return sorted(ways, key=lambda x: (ways[x], len(x), x))

    def restore(self, text: str) -> str:
        """Restore every garbled token; where several ways lead to plausible spellings, the way that suits the whole text best."""
        found = {w: self.token(w) for w in dict.fromkeys(self.suspects(text)) if self.token(w)[0]}
        ranked = self.ways(found, text)

        def one(m: re.Match) -> str:
            w = m[0]
            new = self.follow(w, ranked[0]) if ranked and not w.isascii() else None
            utf8 = ranked and ranked[0][-1][-1:] in (("utf-8",), (PARTS,))  # which chance hardly ever decodes
            if w in found:
                new = self.follow(w, ranked[0]) if ranked else None
                if new is not None and self.rank.cost(new) <= self.rank.cost(w) - SAVES:
                    return new
                if new is not None and self.pairs and not utf8 and self.price(new) < self.price(w) - SAVES:
                    return new
                return found[w][1]
            # single letters of a garbled text may look plausible by themselves
            if new is not None and new != w:
                if self.pairs and not utf8:
                    return new if self.price(new) < self.price(w) else w
                if self.rank.cost(new) <= self.rank.cost(w) - (0 if utf8 else 0.5):
                    return new
            return w

        return TOKEN.sub(one, text)


def letter_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n): pairs of neighbouring letters, and of a blank and a letter at the ends, in all words with other than ASCII letters
    below LETTERS; words of tokens that look garbled by their characters don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = Plausibility()
        for b in batches:
            words: Counter = Counter()
            for t in b["text"]:
                words.update(w for w in WORD.findall(t) if not w.isascii())
            pairs: Counter = Counter()
            for w, n in words.items():
                if max(w) < chr(LETTERS) and rank.cost(w) < CALM + rank.frequent(w):
                    low = f" {w.lower()} "
                    for ab in map("".join, zip(low, low[1:])):
                        pairs[ab] += n
            yield objects(pd.DataFrame({"pair": pd.Series(list(pairs), dtype=object), "n": pd.Series(list(pairs.values()), dtype="int64")}))

    texts = docs.where(F.col(text_col).rlike(r"[^\x00-\x7F]")).select(F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored, complete) for every garbled document; all others are left out. complete: no trace is left.

    Null, empty and plain texts are never garbled. Other columns are ignored; repeated ids give repeated rows.
    """

    counts = letter_pairs(docs, text_col).where("length(pair) = 2").collect()  # at most LETTERS squared
    shared = docs.sparkSession.sparkContext.broadcast({r.pair: r.n for r in counts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(shared.value)
        for b in batches:
            hit = [r.garbled(t) for t in b["text"]]
            b = b[hit]
            text = [r.restore(t) for t in b["text"]]
            complete = pd.Series([not r.garbled(t) for t in text], index=b.index, dtype=bool)
            yield pd.DataFrame({"doc_id": b["id"], "restored": pd.Series(text, index=b.index, dtype=object), "complete": complete})

    odd = docs.where(F.col(text_col).rlike(r"[^\x00-\x7F]|&#?\w+;"))
    return odd.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id bigint, restored string, complete boolean")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(read(spark, sf_dir, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(read(spark, sf_dir, "documents"))
