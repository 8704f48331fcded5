"""Splits that keep related records together.

Method: rows are linked through a bipartite graph of paper keys and question keys. A Borůvka-style contraction takes, round
by round, the minimum edge of every component, keeps it in a persisted spanning forest and merges its ends. Groups (the
roots) are stratified by size band and dealt systematically to the splits.

Scale: one edge per distinct (paper, question), whatever the number of rows. The minimum edge of a hot node is found by a
partial aggregate before the shuffle. Joins on hot keys are split by the adaptive skew join, as the large side is always the
streamed one. The driver only sees counters: rows by size band and split, of which there are at most 64 bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, paper_key, persist_table, query_key, read

#: Blocks per size band for running totals without a single-task sort.
BLOCKS = 256


def contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connected components of an undirected graph edges(u bigint, v bigint), and a spanning forest of it.

    Returns (labels(node, comp), forest(u, v)). Self loops, repeated edges and null ends are ignored; nodes without an
    edge aren't listed. An empty input gives empty outputs.
    """
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # a hashed weight makes the chains of minimum edges short; (w, u, v) is a total order, so that no cycle of equal weights comes up
    live = persist_table(e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct(F.xxhash64("u", "v").alias("w"), "u", "v").alias("e")), "edges")
    labels, forest = None, []
    while not live.isEmpty():
        both = live.select("a", "b", "e").union(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = persist_table(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("p"), "m.e"), "best")
        forest.append(persist_table(best.select("e.u", "e.v").distinct(), "forest"))
        back = best.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        root = (F.col("pp") == F.col("a")) & (F.col("a") < F.col("p"))
        ptr = persist_table(best.join(back, "p", "left").select("a", F.when(root, F.col("a")).otherwise(F.col("p")).alias("p"), F.lit(True).alias("moved")), "ptr")
        drop_table(best)
        while True:  # two jumps a table
            up = ptr.select(F.col("a").alias("p"), F.col("p").alias("q"))
            far = ptr.select("a", "p").join(up, "p", "left").select("a", F.col("q").alias("p"))
            up = up.select(F.col("p").alias("q"), F.col("q").alias("r"))
            new = persist_table(far.withColumnRenamed("p", "q").join(up, "q", "left").select("a", F.col("r").alias("p"), (F.col("r") != F.col("q")).alias("moved")), "ptr")
            drop_table(ptr)
            ptr = new
            if ptr.where("moved").isEmpty():
                break
        if labels is None:
            new = ptr.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            new = labels.join(ptr.select(F.col("a").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        new = persist_table(new, "labels")
        if labels is not None:
            drop_table(labels)
        labels = new
        new = persist_table(
            live.join(ptr.select("a", F.col("p").alias("pa")), "a").join(ptr.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa != pb").groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.min("e").alias("e")),
            "edges",
        )
        drop_table(live)
        drop_table(ptr)
        live = new
    if labels is None:
        return spark.createDataFrame([], "node bigint, comp bigint"), spark.createDataFrame([], "u bigint, v bigint")
    tree = forest[0]
    for f in forest[1:]:
        tree = tree.union(f)
    return labels, tree


def _keyed(rows: DataFrame) -> DataFrame:
    k = rows.select("span_row_id", paper_key(F.col("paper_id")).alias("pk"), query_key(F.col("query")).alias("qk"))
    return k.select("span_row_id", "pk", "qk", F.xxhash64(F.lit("p"), "pk").alias("p"), F.xxhash64(F.lit("q"), "qk").alias("q")).withColumns(
        {"p": F.when(F.col("pk").isNotNull(), F.col("p")), "q": F.when(F.col("qk").isNotNull(), F.col("q"))}
    )


def groups(rows: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((span_row_id, comp, group_paper), forest(u, v)): the group of every row and the smallest plain paper id in it, and the spanning
    forest over the hashed keys of papers and questions that the groups come from.

    Null, blank and filler keys link nothing; a row with neither key is a group of its own, with a null group_paper.
    Ids that papers doesn't list have their lower-case spelling. Repeated rows each get the same group.
    """
    keyed = persist_table(_keyed(rows), "keyed")
    edges = keyed.where("p is not null and q is not null").select(F.col("p").alias("u"), F.col("q").alias("v"))
    labels, forest = contract(edges)
    plain = papers.select(paper_key(F.col("anthology_id")).alias("pk"), F.col("anthology_id").alias("plain")).where("pk is not null").groupBy("pk").agg(F.min("plain").alias("plain"))
    named = keyed.where("p is not null").groupBy("p").agg(F.first("pk").alias("pk")).join(plain, "pk", "left")
    named = named.join(labels.withColumnRenamed("node", "p"), "p", "left").select(F.coalesce("comp", "p").alias("comp"), F.coalesce("plain", "pk").alias("plain"))
    smallest = named.groupBy("comp").agg(F.min("plain").alias("group_paper"))
    node = F.coalesce("p", "q", F.xxhash64(F.lit("r"), "span_row_id"))
    rows_of = (
        keyed.select("span_row_id", node.alias("node"))
        .join(labels, "node", "left")
        .select("span_row_id", F.coalesce("comp", "node").alias("comp"))
        .join(smallest, "comp", "left")
        .select("span_row_id", "comp", "group_paper")
    )
    return rows_of, forest


def deal(grouped: DataFrame, targets: DataFrame) -> DataFrame:
    """Give every row of grouped(span_row_id, comp, ...) a split, whole groups at a time.

    targets(split, target_share) is a small fixed table; shares are taken relative to their sum. Size bands (powers of two) are dealt
    from the largest on. In a band the groups lie in hashed order on a line that repeats, many times if there are many of them, what the
    splits still lack, the one that lacks most first; a group's middle decides. So what a band of few large groups leaves uneven, the
    next bands even out. No rows give no rows.
    """
    share = {r[0]: float(r[1]) for r in targets.where("target_share > 0").collect()}
    if not share:
        raise ValueError("no split with a positive target_share")
    whole = sum(share.values())
    sizes = persist_table(grouped.groupBy("comp").agg(F.count("*").alias("n")), "sizes")
    small = sizes.select("comp", "n", F.floor(F.log2("n")).alias("band"), F.xxhash64(F.lit("deal"), "comp").alias("o")).withColumn("block", F.shiftrightunsigned(F.col("o"), 56))
    per = small.groupBy("band", "block").agg(F.sum("n").alias("s"))  # at most 64 x BLOCKS rows
    over = Window.partitionBy("band").orderBy("block")
    per = per.select("band", "block", (F.sum("s").over(over) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("band")).alias("band_rows"))
    within = Window.partitionBy("band", "block").orderBy("o", "comp")
    line = small.join(F.broadcast(per), ["band", "block"]).withColumn("mid", F.col("before") + F.sum("n").over(within) - F.col("n") / 2)
    cycles = F.greatest(F.lit(1), F.floor(F.col("band_rows") / (32 * F.pow(F.lit(2.0), F.col("band") + 1))))
    u = F.col("mid") / F.col("band_rows") * cycles
    line = persist_table(line.select("comp", "n", "band", (u - F.floor(u)).alias("u")), "line")
    bands = {r.band: r.s for r in line.groupBy("band").agg(F.sum("n").alias("s")).collect()}
    lack = {s: x / whole * sum(bands.values()) for s, x in sorted(share.items())}
    choice = F.lit(None).cast("string")
    for band in sorted(bands, reverse=True):
        rest = {s: max(0.0, x) for s, x in sorted(lack.items(), key=lambda p: (-p[1], p[0]))}
        left, at, pick = sum(rest.values()) or 1.0, 0.0, F.lit(list(rest)[-1])
        bounds = []
        for s, x in rest.items():
            at += x / left
            bounds.append((s, at))
        for s, b in reversed(bounds[:-1]):
            pick = F.when(F.col("u") < b, F.lit(s)).otherwise(pick)
        for r in line.where(F.col("band") == band).groupBy(pick.alias("split")).agg(F.sum("n").alias("s")).collect():
            lack[r.split] -= r.s
        choice = F.when(F.col("band") == band, pick).otherwise(choice)
    return grouped.select("span_row_id", "comp").join(line.select("comp", choice.alias("split")), "comp").select("span_row_id", "comp", "split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "span_rows"), read(spark, sf_dir, "papers"))[0].select("span_row_id", "group_paper")


def _dealt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grouped, forest = groups(read(spark, sf_dir, "span_rows"), read(spark, sf_dir, "papers"))
    return deal(persist_table(grouped, "groups"), read(spark, sf_dir, "split_targets")), forest


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its group and its split."""
    return _dealt(spark, sf_dir)[0].select("span_row_id", F.col("comp").alias("group_id"), "split")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split: rows, groups, and the share of the rows reached beside the target."""
    dealt = persist_table(_dealt(spark, sf_dir)[0], "dealt")
    total = dealt.count()
    got = dealt.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("comp").alias("groups"))
    zero = F.lit(0)
    return read(spark, sf_dir, "split_targets").select("split", "target_share").join(F.broadcast(got), "split", "left").select(
        "split", "target_share", (F.coalesce("rows", zero) / max(1, total)).alias("reached_share"), F.coalesce("rows", zero).alias("rows"), F.coalesce("groups", zero).alias("groups")
    )


def p1_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and groups dealt, groups that lie in two splits, splits off their share by over a hundredth of the rows, and how far the forest
    is from a spanning one: linked keys less linked groups less its edges."""
    dealt, forest = _dealt(spark, sf_dir)
    dealt = persist_table(dealt, "dealt")
    targets = F.broadcast(read(spark, sf_dir, "split_targets").select("split", "target_share"))
    total = dealt.count()
    off = dealt.groupBy("split").agg(F.count("*").alias("n")).join(targets, "split", "right").where(F.abs(F.coalesce("n", F.lit(0)) / max(1, total) - F.col("target_share")) > 0.01)
    per = dealt.groupBy("comp").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_split"), F.count("*").alias("groups"), F.count_if(F.col("s") > 1).alias("groups_in_two_splits")
    )
    nodes = forest.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    linked = contract(forest)[0]
    tree = nodes.count() - linked.select("comp").distinct().count() - forest.count()
    return per.select("rows_split", "groups", "groups_in_two_splits", F.lit(off.count()).cast("bigint").alias("splits_off"), F.lit(tree).cast("bigint").alias("not_spanning"))
