"""Near-duplicate records with small edits.

Method: b-bit MinHash. Texts with the same shingles form one class from the start, so copies never meet in a band. Each
class has 36 band keys of 4 minima; classes that share one are candidates. Their packed 4-bit signatures give a
collision-corrected similarity by bit counts, which drops chance candidates with a margin of 5 standard deviations; the
rest is decided by the exact Jaccard similarity of the shingle sets.

Recall: a pair of similarity s shares a band with probability 1 - (1 - s^4)^36: 0.993 at 0.6, 0.9994 at 0.66, 0.99998 at 0.7.

Scale: the band table holds two longs per class and band and is shuffled once by band key; text is only read again for
candidates. The work beyond that is in proportion to the pairs that are really similar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_table, read
from .p1_splits import contract
from .sketch import estimate, shingle_sets, sketches

ROWS, BANDS, BITS = 4, 36, 4
#: 5 standard deviations of the estimate at 144 hashes.
MARGIN = 0.2


def similar_classes(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members(id, set_key, n), links(a, b, similarity)): the class of every non-null text and the pairs a < b of classes
    whose shingle sets are at least threshold similar.

    Texts without a shingle are similar to equal texts only; null texts are left out; ids should be unique, a repeated id
    gives repeated members. Any other columns are ignored.
    """
    full = persist_table(sketches(rows, id_col, text_col, words=words, rows=ROWS, bands=BANDS, bits=BITS), "sketches")
    members = full.select("id", "set_key", "n")
    classes = full.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = persist_table(classes, "classes")
    keys = classes.select("set_key", F.explode("bands").alias("band"))
    pairs = (
        keys.select("band", F.col("set_key").alias("a")).hint("merge").join(keys.select("band", F.col("set_key").alias("b")), "band").where("a < b").select("a", "b").distinct()
    )
    one = classes.select(F.col("set_key").alias("a"), F.col("rep").alias("rep_a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = classes.select(F.col("set_key").alias("b"), F.col("rep").alias("rep_b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    pairs = pairs.join(one, "a").join(two, "b").where(f"least(na, nb) >= {threshold} * greatest(na, nb)").where(estimate("bits_a", "bits_b", ROWS * BANDS, BITS) >= threshold - MARGIN)
    pairs = persist_table(pairs.select("a", "b", "rep_a", "rep_b"), "pairs")
    wanted = pairs.select(F.col("rep_a").alias("id")).union(pairs.select("rep_b")).distinct()
    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    sets = persist_table(shingle_sets(texts, "id", "text", words), "sets")
    links = (
        pairs.join(sets.select(F.col("id").alias("rep_a"), F.col("shingles").alias("sa")), "rep_a")
        .join(sets.select(F.col("id").alias("rep_b"), F.col("shingles").alias("sb")), "rep_b")
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .select("a", "b", (F.col("both") / (F.size("sa") + F.size("sb") - F.col("both"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return members, persist_table(links.distinct(), "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = similar_classes(read(spark, sf_dir, "span_rows").select("span_row_id", "chunk"), "span_row_id", "chunk")
    m = members.select("id", "set_key")
    touched = persist_table(m.join(links.select(F.col("a").alias("set_key")).union(links.select("b")).distinct(), "set_key", "left_semi"), "touched")
    apart = links.join(touched.select(F.col("set_key").alias("a"), F.col("id").alias("x")), "a").join(touched.select(F.col("set_key").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    repeated = m.groupBy("set_key").agg(F.count("*").alias("c")).where("c > 1")
    copies = persist_table(m.join(repeated.select("set_key"), "set_key", "left_semi"), "copies")
    same = copies.select("set_key", F.col("id").alias("x")).join(copies.select("set_key", F.col("id").alias("y")), "set_key").where("x < y").select("x", "y")
    return apart.union(same).select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """members and links of similar_classes -> (id, class_id, group_id, links): classes and groups by the smallest id in them, and the number of other
    classes linked to a row's own. Groups are classes linked directly or through others."""
    labels, _ = contract(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.explode(F.array("a", "b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("links"))
    reps = members.groupBy("set_key").agg(F.min("id").alias("class_id")).join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").join(degree, "set_key", "left")
    reps = persist_table(reps.select("set_key", "class_id", F.coalesce("comp", "set_key").alias("comp"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links")), "reps")
    groups = reps.groupBy("comp").agg(F.min("class_id").alias("group_id"))
    return members.select("id", "set_key").join(reps.join(groups, "comp"), "set_key").select("id", "class_id", "group_id", "links")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with a chunk: its class of exact copies, its near-duplicate group (classes linked as in p4_found, directly or through others) and
    the number of other classes linked to its own."""
    found = similar_classes(read(spark, sf_dir, "span_rows").select("span_row_id", "chunk"), "span_row_id", "chunk")
    return grouped(*found).select(F.col("id").alias("span_row_id"), "class_id", "group_id", "links")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of p4_found between classes of exact copies, by the smallest row of each: (row_a, row_b, rows_a, rows_b, similarity).
    The pairs of copies aren't expanded; p4_groups has the members."""
    members, links = similar_classes(read(spark, sf_dir, "span_rows").select("span_row_id", "chunk"), "span_row_id", "chunk")
    per = members.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    j = links.join(per.select(F.col("set_key").alias("a"), F.col("rep").alias("x"), F.col("rows").alias("rx")), "a").join(per.select(F.col("set_key").alias("b"), F.col("rep").alias("y"), F.col("rows").alias("ry")), "b")
    first = F.col("x") < F.col("y")
    return j.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"), F.when(first, F.col("rx")).otherwise(F.col("ry")).alias("rows_a"), F.when(first, F.col("ry")).otherwise(F.col("rx")).alias("rows_b"), F.round("similarity", 6).alias("similarity"))
