"""Text algorithms that need Python, as plain functions and as Arrow functions."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s|$)|(?=\n\s*\n)|$)", re.S)


def clean_markdown(text: str) -> str:
    """Character references resolved, runs of blanks within a line collapsed, indentation kept."""
    return re.sub(r"(?<=\S) {2,}(?=\S)", " ", html.unescape(text))


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of sentences: up to . ! ? before white space, a blank line, or the end."""
    out = []
    for m in SENTENCE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def chunks(text: str, least: int = 500, most: int = 5000) -> list[tuple[int, int]]:
    """Section-aware chunks: blocks between blank lines (tables and fenced code stay whole) are joined up to `most` characters; a
    heading opens a new chunk once the current one has `least`. A single block above `most` is cut at its last line or blank."""
    blocks, at, fence, start = [], 0, False, None
    for line in text.split("\n"):
        end = at + len(line)
        s = line.strip()
        if s.startswith("```"):
            fence = not fence
            start = at if start is None else start
        if not s and not fence:
            if start is not None:
                blocks.append((start, at - 1))
                start = None
        elif start is None:
            start = at
        at = end + 1
    if start is not None:
        blocks.append((start, len(text)))
    out: list[list[int]] = []
    for a, b in blocks:
        heading = text[a:b].startswith("#")
        if out and b - out[-1][0] <= most and not (heading and out[-1][1] - out[-1][0] >= least):
            out[-1][1] = b
        else:
            while b - a > most:
                cut = max(text.rfind("\n", a + 1, a + most), text.rfind(" ", a + 1, a + most))
                cut = cut if cut > a + most // 2 else a + most
                out.append([a, cut])
                a = cut
            out.append([a, b])
    return [(a, b) for a, b in out if text[a:b].strip()]


def align(chunk: str, text: str) -> tuple[int, int] | None:
    """Where a text lies in the chunk: exactly, disregarding case, or disregarding case and the kind of white space."""
    if not text:
        return None
    at = chunk.find(text)
    if at < 0 and len(chunk.lower()) == len(chunk):
        at = chunk.lower().find(text.lower())
    if at >= 0:
        return at, at + len(text)
    words = text.split()
    if not words:
        return None
    m = re.search(r"\s+".join(map(re.escape, words)), chunk, re.I)
    return m.span() if m else None


def fuzzy_locate(chunk: str, text: str, least: float = 0.9) -> tuple[int, int, float] | None:
    """The window of the chunk most like a text: 1 - edits / (2 * length) by insertions and deletions, the first of equal ones.

    A semi-global alignment by dynamic programming over bytes of equal length; null below `least`."""
    import numpy as np

    if not text or not chunk:
        return None
    at = chunk.find(text)
    if at >= 0:
        return at, at + len(text), 1.0
    t = np.frombuffer(chunk.encode("utf-32-le"), dtype=np.uint32)
    n = len(t)
    cost, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for c in text:
        up, left_start = cost + 1, start
        match = np.full(n + 1, 1 << 40)
        match[1:] = np.where(t == ord(c), cost[:-1], 1 << 40)
        best = np.minimum(up, match)
        from_match = match <= up
        new_start = np.where(from_match, np.concatenate([[0], start[:-1]]), left_start)
        # cheapest insertions of chunk characters: running minimum of best - position
        low = np.minimum.accumulate(best - ramp)
        src = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost, start = low + ramp, new_start[src]
    length = ramp - start
    score = 1 - cost / np.maximum(1, len(text) + length)
    k = int(np.argmax(score))
    return (int(start[k]), k, float(round(score[k], 4))) if score[k] >= least else None


def first_json(text: str) -> dict | None:
    """The first balanced JSON object of a text, strings and escapes respected."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def question_types(text: str) -> list[str]:
    """Names of question types in an answer: under a usual key or as values, plain or as objects with a type or name."""
    value = first_json(text)
    if value is None:
        return []
    items = next((value[k] for k in ("question_types", "q_types", "types") if k in value), list(value.values()))
    items = items if isinstance(items, list) else [items]
    names = (x if isinstance(x, str) else (x.get("type") or x.get("name")) if isinstance(x, dict) else None for x in items)
    return [x for x in names if isinstance(x, str)]


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by a suffix automaton."""
    nxt, link, size, last = [{}], [-1], [0], 0
    for c in a:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                k = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = k
                    p = link[p]
                link[q] = link[cur] = k
        last = cur
    best = state = run = 0
    for c in b:
        while state and c not in nxt[state]:
            state = link[state]
            run = size[state]
        if c in nxt[state]:
            state, run = nxt[state][c], run + 1
        best = max(best, run)
    return best


_OFFSETS = [StructField("start", IntegerType()), StructField("end", IntegerType())]
SPAN = ArrayType(StructType(_OFFSETS))


@F.pandas_udf(StringType())
def clean_markdown_udf(t: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else clean_markdown(x) for x in t], dtype=object)


@F.pandas_udf(SPAN)
def sentences_udf(t: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else [{"start": a, "end": b} for a, b in sentences(x)] for x in t], dtype=object)


@F.pandas_udf(SPAN)
def chunks_udf(t: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else [{"start": a, "end": b} for a, b in chunks(x)] for x in t], dtype=object)


@F.pandas_udf(StructType([*_OFFSETS, StructField("score", DoubleType())]))
def align_udf(chunk: pd.Series, text: pd.Series) -> pd.DataFrame:
    got = [align(c, t) if c is not None and t is not None else None for c, t in zip(chunk, text)]
    got = [(*g, 1.0) if g else fuzzy_locate(c, t) if c and t else None for g, c, t in zip(got, chunk, text)]
    return pd.DataFrame({"start": pd.array([g[0] if g else None for g in got], dtype="Int32"), "end": pd.array([g[1] if g else None for g in got], dtype="Int32"), "score": pd.array([g[2] if g else None for g in got], dtype="Float64")})


@F.pandas_udf(SPAN)
def token_offsets_udf(t: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else [{"start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", x)] for x in t], dtype=object)


@F.pandas_udf(ArrayType(StructType([*_OFFSETS, StructField("line", StringType())])))
def lines_udf(t: pd.Series) -> pd.Series:
    def one(x: str) -> list[dict]:
        out, at = [], 0
        for line in x.split("\n"):
            out.append({"start": at, "end": at + len(line), "line": line})
            at += len(line) + 1
        return out

    return pd.Series([None if x is None else one(x) for x in t], dtype=object)
