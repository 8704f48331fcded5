"""Steps around models: questions for chunks, annotation of pairs, pruners and highlighters, dense embeddings, token tagging in windows.

Each takes a provider (a picklable object, one per task) and has a deterministic stand-in, so that pipelines run and are tested offline. A failing
call gives its rows an error and an empty result, never a failing job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import align, first_json, question_types, sentences
from .providers import LexicalScorer, TextProvider

SPANS = "array<struct<start:int,end:int,text:string>>"


class Pruner(Protocol):
    def prune(self, query: str, text: str) -> str: ...


class Highlighter(Protocol):
    def highlight(self, query: str, text: str) -> list[tuple[str, float]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Tagger(Protocol):
    def probabilities(self, question: list[str], tokens: list[list[str]]) -> list[list[float]]: ...


class HashedEmbedder:
    """Unit vectors of hashed word counts with signs."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.size))
        for row, t in zip(out, texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = xxhash.xxh64_intdigest(w)
                row[h % self.size] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class LexicalPruner:
    """Keeps the sentences that share at least a tenth of the query's longer words."""

    def __init__(self, threshold: float = 0.1):
        self.threshold = threshold

    def prune(self, query: str, text: str) -> str:
        parts = [text[a:b] for a, b in sentences(text)]
        return " ".join(p for p, s in zip(parts, LexicalScorer().scores(query, parts)) if s >= self.threshold)


class LexicalHighlighter:
    def highlight(self, query: str, text: str) -> list[tuple[str, float]]:
        parts = [text[a:b] for a, b in sentences(text)]
        return list(zip(parts, LexicalScorer().scores(query, parts)))


class WordTagger:
    """1 for tokens that are words of the question, longer than three letters."""

    def probabilities(self, question: list[str], tokens: list[list[str]]) -> list[list[float]]:
        q = {w.lower().strip(".,;:?!()") for w in question}
        return [[float(len(t) > 3 and t.lower().strip(".,;:?!()") in q) for t in w] for w in tokens]


class Echo:
    """A text provider for tests: answers by the first rule whose pattern is found in the prompt."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((a for p, a in self.rules if re.search(p, x)), "") for x in prompts]


def _merged(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, those with nothing but white space between as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and not text[out[-1][1] : a].strip():
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b, "text": text[a:b]} for a, b in out]


def _flat(t: str) -> str:
    return re.sub(r"\W+", " ", t.lower()).strip()


def _per_row(rows: DataFrame, one) -> DataFrame:
    """rows(row_id, query, chunk) with one(query, chunk) -> spans; a failure becomes the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, query, chunk in zip(b["row_id"], b["query"], b["chunk"]):
                try:
                    out.append((rid, one(query or "", chunk or ""), None))
                except Exception as x:
                    out.append((rid, [], f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["row_id", "pred_spans", "error"], dtype=object).astype({"row_id": "int64"})

    return rows.select("row_id", "query", "chunk").mapInPandas(run, f"row_id bigint, pred_spans {SPANS}, error string")


def pruned_spans(rows: DataFrame, pruner: Pruner) -> DataFrame:
    """The sentences of a chunk that its pruned text still has (letters and digits compared), neighbours merged. Null texts are empty ones."""

    def one(query: str, chunk: str) -> list[dict]:
        left = f" {_flat(pruner.prune(query, chunk))} "
        return _merged(chunk, [(a, b) for a, b in sentences(chunk) if (s := _flat(chunk[a:b])) and f" {s} " in left])

    return _per_row(rows, one)


def highlighted_spans(rows: DataFrame, highlighter: Highlighter, threshold: float = 0.5, by: str = "sentences") -> DataFrame:
    """Texts that a highlighter scores with at least threshold, placed in the chunk exactly or but for case. by: 'sentences' widens each to the sentences it
    touches and merges neighbours, 'spans' keeps them as they are. Texts that don't occur are dropped."""
    if by not in ("sentences", "spans"):
        raise ValueError("by must be 'sentences' or 'spans'")

    def one(query: str, chunk: str) -> list[dict]:
        found = [p for t, s in highlighter.highlight(query, chunk) if s >= threshold and t and (p := align(chunk, t))]
        if by == "spans":
            return [{"start": a, "end": b, "text": chunk[a:b]} for a, b in sorted(set((p[0], p[1]) for p in found))]
        return _merged(chunk, [(a, b) for a, b in sentences(chunk) if any(x[0] < b and x[1] > a for x in found)])

    return _per_row(rows, one)


def annotated_pairs(rows: DataFrame, provider: TextProvider, prompt: str = "Question: {query}\nText: {chunk}") -> DataFrame:
    """Single pairs of question and chunk annotated by a text provider: its JSON object's `answerable` and `spans` (texts), placed in the chunk; texts that
    don't occur are dropped. No JSON gives not answerable without spans; a failing call an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chunks = [c or "" for c in b["chunk"]]
            try:
                said, error = provider.complete([prompt.format(query=q or "", chunk=c) for q, c in zip(b["query"], chunks)]), None
            except Exception as x:
                said, error = [""] * len(b), f"{type(x).__name__}: {x}"
            out = []
            for rid, c, t in zip(b["row_id"], chunks, said):
                d = first_json(t or "") or {}
                texts = [x["text"] if isinstance(x, dict) else x for x in d.get("spans") or [] if isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str)]
                at = [p for x in texts if x and (p := align(c, x))]
                out.append((rid, bool(d.get("answerable", bool(at))), [{"start": p[0], "end": p[1], "text": c[p[0] : p[1]]} for p in at], error))
            yield pd.DataFrame(out, columns=["row_id", "answerable", "pred_spans", "error"], dtype=object).astype({"row_id": "int64", "answerable": bool})

    return rows.select("row_id", "query", "chunk").mapInPandas(run, f"row_id bigint, answerable boolean, pred_spans {SPANS}, error string")


def questioned(chunks: DataFrame, classify: TextProvider, generate: TextProvider, definitions: dict[str, str], most: int = 3) -> DataFrame:
    """chunks(row_id, chunk) -> (row_id, type, question, error): the types a first provider names (at most `most`, those without a definition give an
    error), and for each the question of a second one. Null chunks are empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            try:
                named = classify.complete([f"Types for:\n{c or ''}" for c in b["chunk"]])
                for rid, c, t in zip(b["row_id"], b["chunk"], named):
                    for kind in question_types(t or "")[:most]:
                        if kind not in definitions:
                            out.append((rid, kind, None, f"unknown type: {kind}"))
                        else:
                            out.append((rid, kind, generate.complete([f"{kind}: {definitions[kind]}\n{c or ''}"])[0], None))
            except Exception as x:
                out += [(rid, None, None, f"{type(x).__name__}: {x}") for rid in b["row_id"] if rid not in {o[0] for o in out}]
            yield pd.DataFrame(out, columns=["row_id", "type", "question", "error"], dtype=object).astype({"row_id": "int64"})

    return chunks.select("row_id", "chunk").mapInPandas(run, "row_id bigint, type string, question string, error string")


def rewritten(rows: DataFrame, provider: TextProvider, source: str, target: str, prompt: str = "{text}") -> DataFrame:
    """rows(row_id, source, target, ...) with target filled by a provider from source, a question's paraphrase or its search query, where it is null or
    blank; a target that is there stays and isn't asked for again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new, error = list(b["t"]), [None] * len(b)
            todo = [i for i, (s, t) in enumerate(zip(b["s"], b["t"])) if s and not (t or "").strip()]
            try:
                for i, a in zip(todo, provider.complete([prompt.format(text=b["s"].iloc[i]) for i in todo]) if todo else []):
                    new[i] = a
            except Exception as x:
                for i in todo:
                    error[i] = f"{type(x).__name__}: {x}"
            yield pd.DataFrame({"row_id": b["row_id"], target: pd.Series(new, index=b.index, dtype=object), "error": pd.Series(error, index=b.index, dtype=object)})

    return rows.select("row_id", F.col(source).alias("s"), F.col(target).alias("t")).mapInPandas(run, f"row_id bigint, `{target}` string, error string")


def embedded(rows: DataFrame, provider: Embedder, item: str, text: str) -> DataFrame:
    """(item, vec) of every text that isn't null, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "vec": list(provider.embed(b["t"].tolist()).astype(np.float32)) if len(b) else []})

    return rows.where(F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("t")).mapInPandas(run, "item bigint, vec array<float>")


def tagged(rows: DataFrame, tagger: Tagger, size: int = 512, overlap: int = 128, threshold: float = 0.5) -> DataFrame:
    """rows(row_id, query, chunk) -> (row_id, pred_spans, score): token tagging over windows. A window holds the whole question and at most size - its
    words of the chunk, sharing `overlap` with the one before; a token in two windows takes its higher probability. Runs of tokens from threshold on
    become spans with their mean probability as score. A question that leaves no room for new words gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, query, chunk in zip(b["row_id"], b["query"], b["chunk"]):
                chunk = chunk or ""
                at = [(m.start(), m.end()) for m in re.finditer(r"\S+", chunk)]
                question = (query or "").split()
                room = size - len(question)
                if not at or room <= overlap:
                    out.append((rid, [], []))
                    continue
                starts = list(range(0, max(1, len(at) - overlap), room - overlap))
                parts = [[chunk[x:y] for x, y in at[i : i + room]] for i in starts]
                p = np.zeros(len(at))
                for i, w in zip(starts, tagger.probabilities(question, parts)):
                    p[i : i + len(w)] = np.maximum(p[i : i + len(w)], w)
                hit = np.flatnonzero(p >= threshold)
                runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
                out.append((rid, [{"start": at[r[0]][0], "end": at[r[-1]][1], "text": chunk[at[r[0]][0] : at[r[-1]][1]]} for r in runs], [float(p[r].mean()) for r in runs]))
            yield pd.DataFrame(out, columns=["row_id", "pred_spans", "scores"], dtype=object).astype({"row_id": "int64"})

    return rows.select("row_id", "query", "chunk").mapInPandas(run, f"row_id bigint, pred_spans {SPANS}, scores array<double>")


def parsed_extractions(rows: DataFrame) -> DataFrame:
    """rows(row_id, answer, chunk) of a generative extractor -> (row_id, pred_spans): texts under `spans` of the first JSON object, placed in the chunk."""

    @F.pandas_udf(SPANS)
    def place(answer: pd.Series, chunk: pd.Series) -> pd.Series:
        out = []
        for a, c in zip(answer, chunk):
            c, d = c or "", first_json(a or "") or {}
            texts = [json.loads(json.dumps(x)) if isinstance(x, str) else (x or {}).get("text") for x in d.get("spans") or []]
            out.append([{"start": p[0], "end": p[1], "text": c[p[0] : p[1]]} for x in texts if x and (p := align(c, x))])
        return pd.Series(out, dtype=object)

    return rows.select("row_id", place("answer", "chunk").alias("pred_spans"))
