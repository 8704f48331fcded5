"""Line metrics of extracted evidence against gold lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T
from ..functions.pytext import lines_udf


def lines_with_offsets(chunk: Column) -> Column:
    """array<struct<start,end,line>> of a text; an Arrow function, as an array that grows in a higher-order function is copied for every line."""
    return lines_udf(chunk)


def touched_lines(chunk: Column, spans: Column) -> Column:
    """Distinct non-blank lines that a span touches, in order, without trailing blanks."""
    hit = F.filter(lines_with_offsets(chunk), lambda x: F.exists(spans, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    return F.array_distinct(F.filter(F.transform(hit, lambda x: F.rtrim(x["line"])), lambda x: F.trim(x) != ""))


def gold_lines(texts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, "\n"))), lambda x: F.rtrim(x)), lambda x: F.trim(x) != ""))


def measures(df: DataFrame, pred: str, gold: str, chunk: str) -> dict[str, Column]:
    """Set precision, recall, F1, exact match, right about emptiness, compression of the chunk, shared words."""
    both = F.size(F.array_intersect(pred, gold))
    empty = (F.size(pred) == 0) & (F.size(gold) == 0)
    p, r = S.safe_div(both, F.size(pred)), S.safe_div(both, F.size(gold))
    kept = F.length(F.array_join(pred, "\n"))
    return {
        "line_p": F.when(empty, 1.0).otherwise(p), "line_r": F.when(empty, 1.0).otherwise(r), "line_f1": F.when(empty, 1.0).otherwise(S.f1(p, r)),
        "exact": F.when(F.array_sort(pred) == F.array_sort(gold), 1.0).otherwise(0.0), "empty_right": F.when((F.size(pred) == 0) == (F.size(gold) == 0), 1.0).otherwise(0.0),
        "compression": 1 - S.safe_div(kept, F.length(chunk)), "word_share": S.safe_div(T.word_count(F.array_join(pred, " ")), T.word_count(F.col(chunk))),
    }


def summary(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Mean and median of each measure (rounded to 4 places)."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[x for m in names for x in (F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.median(m), 4).alias(f"{m}_median"))])
