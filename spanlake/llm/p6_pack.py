"""Filling fixed-capacity containers with items.

Method: the configuration program over the length histogram, one class per length. Multiplicative weights price the lengths by
how far their coverage lags behind; the configuration of the greatest value is found by knapsack dynamic programming over exact
sums, so among nearly equal values the fullest one is taken. Its containers grow in steps of UNIT-th parts of the program's
size, or until the first of its lengths runs out: steps of whole containers, so that rounding loses nothing but what is left when the
unplaced volume falls below TAIL. That residue alone is packed best fit, longest first.

Pricing is partial: a round prices PART lengths, those that lag most and a choice of the others, and all where these give no
configuration that is full. Weights rise faster than lengths, as short items still fit when long ones don't. Full pricings
with those weights, and with the lengths themselves as weights, bound the program from below (linear-program duality).

The whole plan is made from the histogram, at most `capacity` numbers, so its size doesn't depend on the number of items; every
capacity is planned by a task of its own. The items then find their container from their rank among the items of their length: a
count by (length, bucket), a running total over buckets, and a row number within the bucket, so that not even a length that a
third of all items have meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import objects, persist_table, read
from .tokens import token_counts

#: Steps of the program's size, lengths of a partial pricing, and the share of the volume that is left to best fit.
UNIT, PART, TAIL = 200, 64, 0.01
#: Rate of the weights in a length's lag, their rise over the length, and the value given up for a fuller configuration, at first and at last.
RATE, RISE, SLACKS = 1.0, 1.5, (0.005, 0.05)
BUCKETS = 512
#: Plan rows that are sent to all executors, of 40 bytes each; a longer plan is joined.
SENT = 1_000_000
PLAN = "limit_name string, length int, first bigint, each int, copies bigint, box bigint, program boolean, bound double"


def knapsack(sizes: list[int], values: np.ndarray, most: list[int], capacity: int, slack: float = 0.0) -> list[int]:
    """How often to take each size, at most most[i] times: the fullest choice within the capacity whose value is at least 1 - slack of the greatest; exact, by dynamic programming over sums."""
    f = np.full(capacity + 1, -np.inf)
    f[0] = 0.0
    steps = []
    for i, (s, v, m) in enumerate(zip(sizes, values, most)):
        m, part = min(m, capacity // s), 1
        while m > 0:  # binary splitting of the multiplicity
            k = min(part, m)
            m, part = m - k, part * 2
            cand = f[: capacity + 1 - k * s] + k * v
            better = cand > f[k * s :] + 1e-12
            steps.append((i, k, better))
            new = f.copy()
            np.copyto(new[k * s :], cand, where=better)
            f = new
    take, c = [0] * len(sizes), int(np.flatnonzero(f >= f.max() * (1 - slack))[-1])
    for i, k, better in reversed(steps):
        at = c - k * sizes[i]
        if at >= 0 and better[at]:
            take[i] += k
            c = at
    return take


def program(hist: dict[int, int], capacity: int, seed: int = 5) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int], float]:
    """(configurations as (containers, times of each length), what they leave unplaced, lower bound of the containers any packing needs).

    The containers of the configurations are whole and never cover a length beyond its number.
    """
    length = np.array(sorted(hist, reverse=True), dtype=np.int64)
    n = np.array([hist[x] for x in length.tolist()], dtype=np.int64)
    rem, rng, out = n.copy(), np.random.default_rng(seed), []
    total = float((length * n).sum())
    unit = max(1, int(total / capacity / UNIT))
    base = length * (1 + RISE * length / capacity)
    bound, asked = total / capacity, 0.0
    while (open_ := float((length * rem).sum())) > TAIL * total:
        lag = rem / n - open_ / total
        live = np.flatnonzero(rem)
        some = live
        if len(live) > PART:
            first = live[np.argsort(-lag[live], kind="stable")]
            some = np.sort(np.concatenate([first[: PART // 2], rng.choice(first[PART // 2 :], PART - PART // 2, replace=False)]))
        for pick, slack in ((some, SLACKS[0]), (some, SLACKS[1]), (live, SLACKS[1])):
            price = base[pick] * np.exp(RATE * lag[pick])
            take = np.array(knapsack(length[pick].tolist(), price.tolist(), rem[pick].tolist(), capacity, slack))
            if take @ length[pick] == capacity:
                break
        used = take > 0
        copies = int(min(unit, (rem[pick][used] // take[used]).min()))
        rem[pick] -= take * copies
        out.append((copies, dict(zip(length[pick][used].tolist(), take[used].tolist()))))
        if open_ <= (1 - asked) * total:  # eight full pricings on the way
            asked += 0.125
            for y in (base * np.exp(RATE * lag), length.astype(float)):
                best = np.array(knapsack(length.tolist(), y.tolist(), n.tolist(), capacity)) @ y
                bound = max(bound, float(n @ y) / float(best))
    return out, {int(x): int(k) for x, k in zip(length, rem) if k}, bound


def best_fit(rem: dict[int, int], capacity: int, rooms_of: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int], dict[int, int]]]:
    """Pack what is left, longest first, each where it fits best, in runs of equal containers; those of rooms_of are open too.
    Returns (containers, what they held before, what was added)."""
    done: list = []
    rooms: list[int] = []
    open_: dict[int, list] = {}

    def put(room: int, m: int, old: dict, new: dict) -> None:
        if room == 0:
            done.append((m, old, new))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((m, old, new))

    for m, old in rooms_of:
        put(capacity - sum(x * k for x, k in old.items()), m, old, {})
    for length in sorted((k for k, v in rem.items() if v), reverse=True):
        left = rem[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                m, old, new = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, m, old, new = capacity, left, {}, {}
            each = min(room // length, left)
            got = min(m, left // each)
            if got < m and (old or new):
                put(room, m - got, old, new)
            put(room - each * length, got, old, {**new, length: new.get(length, 0) + each})
            left -= got * each
    return done + [x for lots in open_.values() for x in lots]


def plan(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, bool]], int, float]:
    """Where the items of each length go: (length, first rank, times per container, containers, first container, placed by the program),
    the number of containers, and a lower bound of it. Items of the full capacity fill a container each."""
    hist = {int(k): int(v) for k, v in hist.items() if k > 0 and v > 0}
    full = hist.pop(capacity, 0)
    runs, rest, bound = program(hist, capacity) if hist else ([], {}, 0.0)
    out, rank, box = [], Counter(), 0
    for m, old, new in [*([(full, {capacity: 1}, {})] if full else []), *best_fit(rest, capacity, runs)]:
        for content, by in ((old, True), (new, False)):
            for length, each in content.items():
                out.append((length, rank[length], each, m, box, by))
                rank[length] += m * each
        box += m
    return out, box, full + bound


def planned(counts: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """The plan of every capacity from counts(limit_name, size, n), a task each; at most `capacity` lengths go into one."""
    cap = dict(capacities)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        name = b["limit_name"].iloc[0]
        rows, _, bound = plan(dict(zip(b["size"].tolist(), b["n"].tolist())), cap[name])
        df = pd.DataFrame(rows, columns=["length", "first", "each", "copies", "box", "program"])
        df.insert(0, "limit_name", name)
        return objects(df.assign(bound=bound))

    hist = counts.where("size > 0").groupBy("limit_name", "size").agg(F.sum("n").alias("n"))
    hist = hist.repartition(len(capacities), "limit_name")  # a number of its own, which isn't coalesced
    return persist_table(hist.groupBy("limit_name").applyInPandas(run, PLAN), "plan")


def _sized(docs: DataFrame, capacities: list[tuple[str, int]], id_col: str, text_col: str, path: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, counts by length and bucket, plan)."""
    sizes = token_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text", path)
    caps = F.array(*[F.struct(F.lit(name).alias("limit_name"), F.lit(cap).alias("cap")) for name, cap in capacities])
    items = sizes.select("doc_id", "tokens", F.explode(caps).alias("c")).select("doc_id", "tokens", "c.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("cap")).cast("int") - 1)
    items = items.select("limit_name", "cap", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    items = items.select("limit_name", "doc_id", "piece", F.least(F.col("cap"), F.col("tokens") - F.col("piece") * F.col("cap")).alias("size"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).alias("bucket"))
    items = persist_table(items, "items")
    counts = persist_table(items.groupBy("limit_name", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    return items, counts, planned(counts, capacities)


def _placed(items: DataFrame, counts: DataFrame, steps: DataFrame, sent: int = SENT) -> DataFrame:
    spark = items.sparkSession
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("limit_name", "size").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("limit_name", "size", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("r", within).join(before, ["limit_name", "size", "bucket"]).select("limit_name", "doc_id", "piece", "size", (F.col("before") + F.col("r")).alias("rank"))
    if steps.count() > sent:
        s = steps.select("limit_name", F.col("length").alias("size"), "first", "each", "copies", "box")
        hit = (F.col("size") == 0) | F.col("rank").between(F.col("first"), F.col("first") + F.col("each") * F.col("copies") - 1)
        where = F.coalesce(F.col("box") + F.floor((F.col("rank") - F.col("first")) / F.col("each")), F.lit(0))
        return ranked.join(s, ["limit_name", "size"], "left").where(hit).select("limit_name", where.alias("container_id"), "doc_id", "piece", F.col("size").alias("tokens"))
    plans = {}
    for name, rows in steps.toPandas().groupby("limit_name"):
        rows = rows.sort_values(["length", "first"])
        plans[name] = (rows["length"].to_numpy(np.int64) * (1 << 40) + rows["first"].to_numpy(), rows["first"].to_numpy(), rows["each"].to_numpy(), rows["box"].to_numpy())
    shared = spark.sparkContext.broadcast(plans)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), dtype=np.int64)
            names, size, rank = b["limit_name"].to_numpy(), b["size"].to_numpy().astype(np.int64), b["rank"].to_numpy()
            for name, (key, first, each, box) in shared.value.items():
                mine = (names == name) & (size > 0)
                if mine.any():
                    k = np.searchsorted(key, size[mine] * (1 << 40) + rank[mine], side="right") - 1
                    out[mine] = box[k] + (rank[mine] - first[k]) // each[k]
            yield objects(pd.DataFrame({"limit_name": names, "container_id": out, "doc_id": b["doc_id"], "piece": b["piece"], "tokens": b["size"]}))

    kind = items.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"limit_name string, container_id bigint, doc_id {kind}, piece int, tokens int")


def packed(docs: DataFrame, capacities: list[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(limit_name, container_id, doc_id, piece, tokens): every text in every capacity's containers.

    A text that alone exceeds a capacity is cut into full pieces and a rest; no other text is cut. Null texts are left out,
    texts without tokens lie in container 0. Repeated ids are items of their own.
    """
    return _placed(*_sized(docs, capacities, id_col, text_col, path))


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = read(spark, sf_dir, "size_limits").where("limit_name like 'pack%' and unit = 'tokens'").select("limit_name", "max_size").collect()
    return sorted((r.limit_name, r.max_size) for r in rows)


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), _capacities(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By capacity: items, containers, the program's lower bound and the gap to it, the share of the tokens (without full containers of one
    piece) that the program's configurations hold, and the share of space unused."""
    cap = _capacities(spark, sf_dir)
    caps = spark.createDataFrame(cap, "limit_name string, capacity int")
    items, counts, steps = _sized(read(spark, sf_dir, "documents"), cap, "doc_id", "text", None)
    boxes = _placed(items, counts, steps).groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    per = boxes.groupBy("limit_name").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    volume = F.col("length") * F.col("each") * F.col("copies")
    own = steps.join(F.broadcast(caps), "limit_name").groupBy("limit_name").agg(
        F.max("bound").alias("bound"), F.sum(F.when(F.col("program") & (F.col("length") < F.col("capacity")), volume)).alias("a"), F.sum(F.when(F.col("length") < F.col("capacity"), volume)).alias("b")
    )
    least = F.ceil(F.col("bound") - 1e-6)
    return per.join(F.broadcast(caps), "limit_name").join(own, "limit_name").select(
        "limit_name", "capacity", "items", "containers", least.alias("least_containers"), (F.col("containers") / least - 1).alias("gap"), (F.coalesce("a", F.lit(0)) / F.col("b")).alias("program_share"), "fullest",
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"),
    )


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By capacity: documents packed, containers over the capacity, documents cut though they'd fit, and documents whose pieces aren't
    full ones and a rest."""
    cap = _capacities(spark, sf_dir)
    caps = F.broadcast(spark.createDataFrame(cap, "limit_name string, capacity int"))
    p = persist_table(p6_pack(spark, sf_dir), "packed")
    over = p.groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("used")).join(caps, "limit_name").groupBy("limit_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("containers_over_capacity"))
    docs = p.groupBy("limit_name", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.max("piece").alias("last")).join(caps, "limit_name")
    docs = docs.groupBy("limit_name").agg(
        F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut_though_fitting"),
        F.count_if((F.col("last") + 1 != F.col("n")) | ((F.col("n") - 1) * F.col("capacity") + F.col("least") != F.col("t"))).alias("cut_unevenly"),
    )
    return docs.join(over, "limit_name").select("limit_name", "documents", "containers_over_capacity", "cut_though_fitting", "cut_unevenly")
