"""Model-backed steps behind small batch providers, with deterministic offline stand-ins.

A provider is a picklable object made once per task; its errors become a column and never stop a job.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import fuzzy_locate, sentences


class TextProvider(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class SpanExtractor(Protocol):
    def extract(self, query: str, chunks: list[str]) -> list[list[str]]: ...


class SentenceScorer(Protocol):
    def scores(self, query: str, sentences: list[str]) -> list[float]: ...


def _words(text: str) -> set[str]:
    return {w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) > 3}


class LexicalScorer:
    """Share of the query's longer words that a sentence holds."""

    def scores(self, query: str, sentences: list[str]) -> list[float]:
        q = _words(query)
        return [len(q & _words(s)) / len(q) if q else 0.0 for s in sentences]


class LexicalExtractor:
    """The sentences with the best lexical score, if it reaches `least`."""

    def __init__(self, least: float = 0.25):
        self.least = least

    def extract(self, query: str, chunks: list[str]) -> list[list[str]]:
        out = []
        for c in chunks:
            parts = [c[a:b] for a, b in sentences(c)]
            s = LexicalScorer().scores(query, parts)
            top = max(s, default=0.0)
            out.append([p for p, x in zip(parts, s) if x == top] if top >= self.least else [])
        return out


def _batches(items: list, n: int) -> Iterator[list]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


EXTRACTED = "pred_spans array<struct<start:int,end:int,text:string>>, predicted_texts array<string>, latency_s double, error string"


def extracted(rows: DataFrame, extractor: SpanExtractor, batch_size: int = 5, least: float = 0.8) -> DataFrame:
    """rows(row_id, query, chunk) with the extractor's spans: calls hold chunks of one query, at most batch_size; texts are located
    in the chunk exactly or from `least` similarity on, others dropped. A failing call gives no spans and its message; the latency is
    shared equally. Rows of a query lie together by sorting within hash partitions of (query, salt), so a hot query has several tasks."""
    salted = rows.select("row_id", "query", "chunk").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, g in b.groupby("query", dropna=False, sort=False):
                for part in _batches(list(zip(g["row_id"], g["chunk"])), batch_size):
                    began, error = time.monotonic(), None
                    try:
                        texts = extractor.extract(query if isinstance(query, str) else "", [c or "" for _, c in part])  # groupby gives NaN for null
                    except Exception as x:  # the provider's failure belongs to the rows
                        texts, error = [[] for _ in part], f"{type(x).__name__}: {x}"
                    each = (time.monotonic() - began) / len(part)
                    for (rid, chunk), found in zip(part, texts):
                        at = [(fuzzy_locate(chunk or "", t, least), t) for t in found]
                        out.append((rid, [{"start": p[0], "end": p[1], "text": (chunk or "")[p[0] : p[1]]} for p, _ in at if p], found, each, error))
            yield pd.DataFrame(out, columns=["row_id", "pred_spans", "predicted_texts", "latency_s", "error"], dtype=object).astype({"row_id": "int64", "latency_s": "float64"})

    return salted.repartition("query", "salt").sortWithinPartitions("query", "row_id").drop("salt").mapInPandas(run, f"row_id bigint, {EXTRACTED}")


def sentence_spans(rows: DataFrame, scorer: SentenceScorer, threshold: float = 0.5) -> DataFrame:
    """rows(row_id, query, chunk) with the sentences that score at least threshold, neighbours merged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, query, chunk in zip(b["row_id"], b["query"], b["chunk"]):
                chunk = chunk or ""
                parts = sentences(chunk)
                keep = [p for p, s in zip(parts, scorer.scores(query or "", [chunk[x:y] for x, y in parts])) if s >= threshold]
                spans: list[list[int]] = []
                for x, y in keep:
                    if spans and not chunk[spans[-1][1] : x].strip():
                        spans[-1][1] = y
                    else:
                        spans.append([x, y])
                out.append((rid, [{"start": x, "end": y, "text": chunk[x:y]} for x, y in spans]))
            yield pd.DataFrame(out, columns=["row_id", "pred_spans"], dtype=object).astype({"row_id": "int64"})

    return rows.select("row_id", "query", "chunk").mapInPandas(run, "row_id bigint, pred_spans array<struct<start:int,end:int,text:string>>")


def completed(rows: DataFrame, provider: TextProvider, prompt: str, batch_size: int = 16) -> DataFrame:
    """rows(row_id, ...) with (answer, error) of a prompt column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for part in _batches(list(zip(b["row_id"], b["p"])), batch_size):
                try:
                    answers, error = provider.complete([p or "" for _, p in part]), None
                except Exception as x:
                    answers, error = [None] * len(part), f"{type(x).__name__}: {x}"
                out += [(rid, a, error) for (rid, _), a in zip(part, answers)]
            yield pd.DataFrame(out, columns=["row_id", "answer", "error"], dtype=object).astype({"row_id": "int64"})

    return rows.select("row_id", F.col(prompt).alias("p")).mapInPandas(run, "row_id bigint, answer string, error string")
