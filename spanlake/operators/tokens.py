"""Token layer: white-space tokens with offsets, overlapping windows, labels from spans, spans from labels, token F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.pytext import token_offsets_udf


def token_offsets(text: Column) -> Column:
    """array<struct<start,end>> of the words of a text, in order. A running array in a higher-order function would be copied for
    every word, so this is an Arrow function."""
    return token_offsets_udf(text)


def windows(rows: DataFrame, keys: list[str], tokens: str, size: int, overlap: int) -> DataFrame:
    """Windows of at most `size` tokens, each sharing `overlap` tokens with the one before; a row without tokens has none."""
    if not 0 < overlap < size:
        raise ValueError("the overlap must lie between 0 and the window size")
    step = size - overlap
    count = F.size(tokens)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((count - F.lit(size)) / F.lit(step)).cast("int")) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return rows.select(*keys, tokens, F.posexplode(starts).alias("window", "first")).select(*keys, "window", "first", F.slice(F.col(tokens), F.col("first") + 1, F.lit(size)).alias("tokens"))


def labels(tokens: Column, spans: Column) -> Column:
    """1 for tokens that overlap a span, else 0."""
    return F.transform(tokens, lambda t: F.exists(spans, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])).cast("int"))


def bio(tokens: Column, spans: Column) -> Column:
    """B for the first token of a span, I for others in it, O outside; the first span that overlaps decides."""
    hit = lambda t: F.try_element_at(F.filter(spans, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])), F.lit(1))
    owner = F.transform(tokens, lambda t: F.coalesce(hit(t)["start"], F.lit(-1)))
    return F.transform(owner, lambda o, i: F.when(o < 0, "O").when((i == 0) | (F.coalesce(F.try_element_at(owner, F.greatest(i, F.lit(1))), F.lit(-2)) != o), "B").otherwise("I"))


def decoded(tokens: Column, tags: Column) -> Column:
    """Spans (start, end) of the runs of non-zero tags; a zero between breaks a run."""
    zipped = F.arrays_zip(tokens.alias("t"), tags.alias("l"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    init = F.struct(F.lit(False).alias("open"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"))
        last = F.element_at(acc["out"], -1)
        grown = F.array_append(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.struct(last["start"].alias("start"), x["t"]["end"].alias("end")))
        return F.when(x["l"] == 0, F.struct(F.lit(False).alias("open"), acc["out"].alias("out"))).when(acc["open"], F.struct(F.lit(True).alias("open"), grown.alias("out"))).otherwise(F.struct(F.lit(True).alias("open"), F.array_append(acc["out"], span).alias("out")))

    return F.aggregate(zipped, init, step, lambda acc: acc["out"])


def token_counts(pred: Column, gold: Column) -> Column:
    """struct<tp,fp,fn,n> of two label arrays; positions labelled -100 in gold are ignored."""
    z = F.filter(F.arrays_zip(pred.alias("p"), gold.alias("g")), lambda x: x["g"] != -100)
    n = lambda c: F.size(F.filter(z, c))
    return F.struct(n(lambda x: (x["p"] != 0) & (x["g"] != 0)).alias("tp"), n(lambda x: (x["p"] != 0) & (x["g"] == 0)).alias("fp"), n(lambda x: (x["p"] == 0) & (x["g"] != 0)).alias("fn"), F.size(z).alias("n"))


def token_f1(rows: DataFrame, by: list[str], counts: str) -> DataFrame:
    a = rows.groupBy(*by).agg(*[F.sum(f"{counts}.{c}").alias(c) for c in ("tp", "fp", "fn", "n")])
    p, r = S.safe_div(F.col("tp"), F.col("tp") + F.col("fp")), S.safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select(*by, "tp", "fp", "fn", F.col("n").alias("tokens"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(S.f1(p, r), 6).alias("f1"))


def sentence_scores(sentences: Column, tokens: Column, probs: Column) -> Column:
    """Mean over a sentence's characters of the highest probability of a token that covers each; 0 for characters no token covers."""
    z = F.arrays_zip(tokens.alias("t"), probs.alias("p"))

    def at(i: Column) -> Column:
        over = F.transform(F.filter(z, lambda x: (x["t"]["start"] <= i) & (x["t"]["end"] > i)), lambda x: x["p"])
        return F.coalesce(F.array_max(over), F.lit(0.0))

    return F.transform(sentences, lambda s: F.aggregate(F.transform(F.sequence(s["start"], s["end"] - 1), at), F.lit(0.0), lambda a, b: a + b) / (s["end"] - s["start"]))


def thresholded(tokens: Column, probs: Column, threshold: float) -> Column:
    """Spans of runs of tokens whose probability reaches the threshold."""
    return decoded(tokens, F.transform(probs, lambda p: (p >= threshold).cast("int")))
