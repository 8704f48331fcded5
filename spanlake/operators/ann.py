"""Approximate dense search by inverted lists.

Centroids are fitted on a bounded hashed sample of vectors (SAMPLE, a parameter); every vector is indexed. A query probes its
nearest lists only; the join on the list number is split where lists are large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k

SAMPLE = 100_000


def fit(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means over at most `sample` vectors(item, vec), the first in hashed order."""
    rows = vectors.where("vec is not null").select("vec", F.xxhash64("item").alias("h")).orderBy("h").limit(sample).select("vec").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vec for r in rows], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _assigned(df: DataFrame, key: str, vec: str, centroids: np.ndarray, probes: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            if not len(b) or not len(c):
                continue
            x = np.array(b["vec"].tolist(), dtype=np.float64)
            order = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
            n = order.shape[1]
            yield pd.DataFrame({"k": np.repeat(b["k"].to_numpy(), n), "vec": [v for v in b["vec"] for _ in range(n)], "list": order.ravel().astype(np.int32)})

    out = df.where(f"{vec} is not null").select(F.col(key).cast("bigint").alias("k"), F.col(vec).cast("array<double>").alias("vec")).mapInPandas(run, "k bigint, vec array<double>, list int")
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE, rows: int = 8192) -> DataFrame:
    """Top k of vectors(item, vec) for queries(query_id, qvec) within the probed lists; an item is no hit of itself.

    lists: the square root of the number of vectors by default. probes: 0.65 of the lists by default, as vectors without any clusters need it for a
    recall of 0.9; clustered ones do with a few. A list meets its queries as one matrix product; lists of more than `rows` vectors are cut into parts,
    each of which meets the queries by itself, so no list is a task's whole work. A part passes on the k best of each query.
    """
    count = vectors.where("vec is not null").count()
    lists = lists or max(1, round(count**0.5))
    probes = probes or max(1, -(-65 * lists // 100))
    c = fit(vectors, lists, sample)
    index = _assigned(vectors, "item", "vec", c, 1)
    parts = index.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # a row a list
    index = index.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("k"), "parts").cast("int")).select("list", "part", "k", "vec")
    asked = _assigned(queries, "query_id", "qvec", c, probes).join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "k", "vec")

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(x.tolist(), dtype=np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "item": [], "score": []}).astype({"query_id": "int64", "item": "int64", "score": "float64"})
        m, item, out = unit(v["vec"]), v["k"].to_numpy(), []
        for at in range(0, len(q), 512):
            ids = q["k"].to_numpy()[at : at + 512]
            s = np.round(unit(q["vec"].iloc[at : at + 512]) @ m.T, 6)
            s[ids[:, None] == item[None, :]] = -2
            order = np.lexsort((np.broadcast_to(item, s.shape), -s), axis=1)[:, :k]
            score = np.take_along_axis(s, order, axis=1).ravel()
            out.append(pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "item": item[order.ravel()], "score": score})[score > -2])
        return pd.concat(out)

    scored = index.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInPandas(best, "query_id bigint, item bigint, score double")
    return top_k(scored, "query_id", "item", "score", k).select("query_id", "rank", "item", "score")
