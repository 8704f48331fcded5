"""Span algebra: half-open code point offsets, as higher-order functions over small arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

SPANS = "array<struct<start:int,end:int,text:string>>"


def slice_of(chunk: Column, start: Column, end: Column) -> Column:
    return F.substring(chunk, start + 1, end - start)


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return safe_div(2 * p * r, p + r)


def valid_spans(spans: Column, chunk: Column) -> Column:
    """Spans with 0 <= start < end <= length; a null text becomes the slice."""
    ok = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(chunk)))
    return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["text"], slice_of(chunk, s["start"], s["end"])).alias("text")))


def locate_text(chunk: Column, text: Column) -> Column:
    """Offset of the first exact occurrence, else the first one disregarding case, else -1."""
    return F.when(F.position(text, chunk) > 0, F.position(text, chunk) - 1).otherwise(F.position(F.lower(text), F.lower(chunk)) - 1)


def aligned_texts(texts: Column, chunk: Column) -> Column:
    """Spans of predicted texts: empty ones skipped, those that don't occur dropped."""
    some = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    at = F.transform(some, lambda t: F.struct(locate_text(chunk, t).alias("start"), t.alias("t")))
    hit = F.filter(at, lambda s: s["start"] >= 0)
    return F.transform(hit, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["t"])).alias("end"), s["t"].alias("text")))


def predicted_spans(spans: Column, texts: Column, chunk: Column) -> Column:
    """Offsets where given, even if all of them turn out invalid; else the aligned texts; else none."""
    none = F.array().cast(SPANS)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, valid_spans(spans, chunk)).otherwise(F.coalesce(aligned_texts(texts, chunk), none)).cast(SPANS)


def _space(c: Column) -> Column:
    return c.rlike(r"(?U)^[\s\x1c-\x1f]$")


def word_range(chunk: Column, s: Column) -> Column:
    """Half-open range of the words that a span touches, from counts of words before its ends."""
    start, end = s["start"], s["end"]
    lead, till = F.regexp_count(F.substring(chunk, F.lit(1), start), F.lit(WORD)), F.regexp_count(F.substring(chunk, F.lit(1), end), F.lit(WORD))
    before, first = F.substring(chunk, start, F.lit(1)), F.substring(chunk, start + 1, F.lit(1))
    inside = (start > 0) & (first != "") & ~_space(before) & ~_space(first)
    lo = lead - F.when(inside, 1).otherwise(0)
    hi = F.when(end > start, till).otherwise(lo + F.when(inside, 1).otherwise(0))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def word_set(chunk: Column, spans: Column) -> Column:
    """Indexes of all words that any of the spans touches."""
    ranges = F.filter(F.transform(spans, lambda s: word_range(chunk, s)), lambda r: r["hi"] > r["lo"])
    return F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"] - 1))))


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def iou(a: Column, b: Column) -> Column:
    i = overlap(a, b)
    return F.when(i > 0, i / ((a["end"] - a["start"]) + (b["end"] - b["start"]) - i)).otherwise(0.0)


def iou_matches(pred: Column, gold: Column, threshold: float) -> Column:
    """Pairs matched one to one, best first; of equal scores the later pair."""
    pairs = F.flatten(F.transform(pred, lambda p, i: F.transform(gold, lambda g, j: F.struct(iou(p, g).alias("s"), i.alias("i"), j.alias("j")))))
    order = F.reverse(F.array_sort(F.filter(pairs, lambda x: x["s"] >= threshold)))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("i"), none.alias("j"))
    free = lambda acc, x: ~F.array_contains(acc["i"], x["i"]) & ~F.array_contains(acc["j"], x["j"])
    step = lambda acc, x: F.when(free(acc, x), F.struct(F.array_append(acc["i"], x["i"]).alias("i"), F.array_append(acc["j"], x["j"]).alias("j"))).otherwise(acc)
    return F.aggregate(order, start, step, lambda acc: F.size(acc["i"]))


def contained(spans: Column, others: Column, threshold: float, by_span: bool) -> Column:
    """How many spans are matched when predictions count as contained from `threshold` of their length on: predictions
    (by_span) or gold spans touched by such a prediction. Empty predictions never match."""
    if by_span:
        hit = lambda p: F.exists(others, lambda g: (p["end"] > p["start"]) & (overlap(p, g) >= threshold * (p["end"] - p["start"])))
    else:
        hit = lambda g: F.exists(others, lambda p: (p["end"] > p["start"]) & (overlap(p, g) >= threshold * (p["end"] - p["start"])))
    return F.size(F.filter(spans, hit))


def merged(spans: Column, gap: int = 0) -> Column:
    """Spans sorted, those that overlap or lie within `gap` characters joined, as (start, end)."""
    pair = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"] + gap, joined).otherwise(F.array_append(acc, s))

    return F.aggregate(pair, none, step)


def post_processed(spans: Column, least: int, gap: int, order: str = "filter_first") -> Column:
    """Short spans dropped and near ones merged, in either order (filter_first or merge_first)."""
    long = lambda s: s["end"] - s["start"] >= least
    if order == "filter_first":
        return merged(F.filter(spans, long), gap)
    return F.filter(merged(spans, gap), long)


def covered_chars(span: Column, union: Column) -> Column:
    """Characters of a span that a union of disjoint spans covers."""
    return F.aggregate(union, F.lit(0), lambda acc, u: acc + overlap(span, u))


def covered(gold: Column, pred: Column, threshold: float) -> Column:
    union = merged(pred)
    return F.size(F.filter(gold, lambda g: (g["end"] > g["start"]) & (covered_chars(g, union) >= threshold * (g["end"] - g["start"]))))


def touched(gold: Column, pred: Column) -> Column:
    return F.size(F.filter(gold, lambda g: F.exists(pred, lambda p: overlap(p, g) > 0)))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
