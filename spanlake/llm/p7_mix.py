"""Mixing sources to target weights.

Method: cube-method balanced sampling. Every document of a source is used floor(k) times for certain and once more with
probability k - floor(k), where k is the source's target over its tokens, at most max_repeats. A flight phase moves these
probabilities through the null space of two constraints, tokens and documents, until two are left in a block; the leftovers of
all blocks fly again. The landing rounds the last few values of each source so that tokens deviate least.

Scale: blocks hold about BLOCK documents however many a source has, so no source meets in one task. The driver sees one row per
mix and source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import objects, persist_table, read
from .tokens import token_counts

#: Documents of a block; values that the landing rounds besides the last two of the flight.
BLOCK, LANDING = 20_000, 12
EPS = 1e-9


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int = 0) -> np.ndarray:
    """Flight phase: p with at most two values strictly between 0 and 1, besides `keep` that stay on the ground; sum(p) and
    sum(p * size) stay as they are, each value's expectation too."""
    p = p.astype(float).copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    # the flight leaves the largest sizes open as a rule; so half of those kept are the largest, which can make up for these, and half of all sizes
    by_size = open_[np.argsort(-size[open_], kind="stable")]
    at = [*range(keep // 2), *np.linspace(keep // 2, max(len(by_size) - 1, keep // 2), keep - keep // 2).astype(int).tolist()]
    kept = set(by_size[[i for i in dict.fromkeys(at) if i < len(by_size)]].tolist()) if keep else set()
    order = [i for i in rng.permutation(open_).tolist() if i not in kept]
    coin = iter(rng.random(3 * len(order) + 3).tolist())
    vals, sz = p.tolist(), size.astype(float).tolist()
    live: list[int] = []
    while True:
        while len(live) < 3 and order:
            live.append(order.pop())
        if len(live) < 3:
            break
        a, b, c = live
        u = (sz[c] - sz[b], sz[a] - sz[c], sz[b] - sz[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(live, u):
            x = vals[i]
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, -x / d), min(down, (x - 1) / d)
        step = up if next(coin) * (up + down) < down else -down
        rest = []
        for i, d in zip(live, u):
            x = vals[i] + step * d
            vals[i] = x = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
            if 0 < x < 1:
                rest.append(i)
        live = rest
    return np.array(vals)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last values, at most LANDING + 2 of them: the choice with the least deviation in size, and a little weight on that
    in number, by trying all."""
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        z = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = np.abs(z @ size[at] - (p[at] * size[at]).sum())
        number = np.abs(z.sum(axis=1) - p[at].sum())
        p[at] = z[np.argmin(off + 0.02 * size[at].mean() * number)]
    return p


def _flight(last: bool, seed: int):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "tokens"], kind="stable")
        import zlib

        rng = np.random.default_rng([seed, zlib.crc32(f"{b['mix_name'].iloc[0]}|{b['source'].iloc[0]}|{b['block'].iloc[0]}".encode())])
        p = fly(b["p"].to_numpy(), b["tokens"].to_numpy(), rng, LANDING if last else 0)
        return objects(b.assign(p=land(p, b["tokens"].to_numpy()) if last else p))

    return run


def targets_of(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One record per row of targets: the tokens wanted, those the source has, and how often its documents are used."""
    have = {r["source"]: (r.t, r.d) for r in sizes.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("d")).collect()}
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    out = []
    for r in targets.orderBy("mix_name", "source").collect():
        t, d = have.get(r.source, (0, 0))
        want = float(r.corpus_share) * total * float(r.target_share)
        k = min(want / t, float(r.max_repeats)) if t else 0.0
        out.append({"mix_name": r.mix_name, "source": r.source, "target_share": float(r.target_share), "max_repeats": r.max_repeats, "wanted": want, "source_tokens": int(t), "source_docs": int(d), "k": k})
    return out


def mixed(docs: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, list[dict]]:
    """((mix_name, source, doc_id, tokens, copies) with copies > 0, records of targets_of).

    Documents without a source or without tokens take no part. A target that max_repeats can't meet is filled as far as it
    goes, the others keep their sizes; an absent source gives no rows. Repeated ids are documents of their own.
    """
    spark = docs.sparkSession
    sizes = persist_table(token_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"], "text", path).where("tokens > 0"), "sizes")
    records = targets_of(sizes, targets)
    rows = [(r["mix_name"], r["source"], int(r["k"] + EPS), max(0.0, r["k"] - int(r["k"] + EPS)), max(1, -(-r["source_docs"] // block))) for r in records if r["k"] > 0]
    table = spark.createDataFrame(rows, "mix_name string, source string, base int, p double, blocks int")
    every = sizes.join(F.broadcast(table), "source").select("mix_name", "source", "doc_id", "tokens", "base", "p", F.pmod(F.xxhash64("doc_id", "mix_name"), F.col("blocks")).cast("int").alias("block"))
    every = persist_table(every, "every")
    chance = every.where(f"p > {EPS}")
    kind = every.schema.simpleString()[7:-1]
    done = every.where(f"p <= {EPS}").select("mix_name", "source", "doc_id", "tokens", "base", F.lit(0.0).alias("p"))
    most = max([r[4] for r in rows], default=1)
    level = 0
    while True:
        last = most == 1
        flown = persist_table(chance.groupBy("mix_name", "source", "block").applyInPandas(_flight(last, seed + level), kind), f"flight{level}")
        if last:
            done = done.unionByName(flown.drop("block"))
            break
        done = done.unionByName(flown.where("p = 0 or p = 1").drop("block"))
        # two are left of each block; they form blocks again
        most = -(-2 * most // block)
        chance = flown.where("p > 0 and p < 1").withColumn("block", F.pmod("block", F.lit(most)))
        level += 1
    copies = (F.col("base") + F.col("p")).cast("int")
    return done.select("mix_name", "source", "doc_id", "tokens", copies.alias("copies")).where("copies > 0"), records


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached beside the targets."""
    chosen, records = mixed(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    table = spark.createDataFrame([(r["mix_name"], r["source"], r["target_share"], r["max_repeats"], r["wanted"], r["source_tokens"]) for r in records], "mix_name string, source string, target_share double, max_repeats int, wanted_tokens double, source_tokens bigint")
    j = table.join(got, ["mix_name", "source"], "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    whole = j.groupBy("mix_name").agg(F.sum("reached_tokens").alias("mix_tokens"), F.sum("wanted_tokens").alias("mix_wanted"))
    share = F.coalesce(F.try_divide(F.col("reached_tokens"), F.col("mix_tokens")), F.lit(0.0))
    return j.join(whole, "mix_name").select(
        "mix_name", "source", "target_share", share.alias("reached_share"), F.coalesce(F.try_divide(F.col("reached_tokens"), F.col("mix_wanted")), F.lit(0.0)).alias("share_of_size"), "wanted_tokens", "reached_tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "source_tokens",
    )


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By target: documents used more often than max_repeats, documents of another source, and 1 if the tokens reached are off what target and
    max_repeats allow by over half a hundredth (or half of the source's smallest document)."""
    docs = read(spark, sf_dir, "documents")
    chosen, records = mixed(docs, read(spark, sf_dir, "mix_targets"))
    chosen = persist_table(chosen, "chosen")
    least = chosen.groupBy("mix_name", "source").agg(F.min("tokens").alias("smallest"), F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    table = [(r["mix_name"], r["source"], r["target_share"], r["max_repeats"], r["k"] * r["source_tokens"]) for r in records]
    table = spark.createDataFrame(table, "mix_name string, source string, target_share double, max_repeats int, allowed double")
    own = docs.select("doc_id", F.col("source").alias("own"))
    bad = chosen.join(own, "doc_id").join(F.broadcast(table), ["mix_name", "source"]).groupBy("mix_name", "source").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("used_too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("of_other_sources")
    )
    zero = F.lit(0).cast("bigint")
    off = F.abs(F.coalesce("reached", zero) - F.col("allowed")) > F.greatest(0.005 * F.col("allowed"), F.coalesce("smallest", zero) / 2, F.lit(1e-6))
    return table.join(least, ["mix_name", "source"], "left").join(bad, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("used_too_often", zero).alias("used_too_often"), F.coalesce("of_other_sources", zero).alias("of_other_sources"), F.when(off, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("missed_targets")
    )
