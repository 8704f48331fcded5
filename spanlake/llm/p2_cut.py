"""Splitting oversized items at natural boundaries.

Method: dynamic programming over boundary positions. Every boundary has a penalty by its kind (paragraph, line, sentence,
clause, blank, none); a piece adds its squared deviation from equal sizes. The cheapest chain of cuts is taken in which no
piece exceeds the limit and each piece starts exactly `overlap` characters before the end of the one before.

Scale: only oversized items leave the JVM. The chunk indexes are a running total over each paper's distinct chunk indexes, in
blocks, so that no paper is numbered by a single task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import paper_key, persist_table, read

# Penalties of a cut by the kind of boundary.
PARAGRAPH, LINE, SENTENCE, WRAP, ROW, CLAUSE, BLANK, NONE, COMBINED = 0.0, 0.15, 0.3, 0.55, 0.6, 0.65, 0.9, 3.0, 6.0
#: Weight of the squared deviation from equal sizes.
IMBALANCE = 1.0
#: Places without any boundary are candidates, every one, in unbroken runs longer than 1/STRETCH of the limit; shorter runs (words) stay whole.
STRETCH = 16
BLOCK = 4096

SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]")
CLAUSE_END = re.compile(r"[;:,，；：、]\s*")
SPACE = re.compile(r"\s+")


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions to cut at, in order and with the text's end, and their penalties."""
    best: dict[int, float] = {}

    def add(pos: int, penalty: float) -> None:
        if 0 < pos < len(text) and penalty < best.get(pos, 9.0):
            best[pos] = penalty

    at, fence, blank_before = 0, False, False
    for line in text.split("\n"):
        end = at + len(line) + 1
        s = line.strip()
        if s.startswith("```"):
            fence = not fence
            inside = ROW if fence else LINE
        elif fence:
            inside = ROW
        elif s.startswith("|") or s.startswith("$$"):
            inside = ROW
        elif not s:
            inside = PARAGRAPH
        else:
            inside = LINE if s[-1] in ".!?:。！？" or s.startswith(("-", "*", "[", "#")) else WRAP
        if s.startswith("#") and not fence:
            add(at, PARAGRAPH)
            inside = WRAP + 0.2  # a heading stays with its text
        elif fence and not s:
            inside = WRAP
        add(end, inside)
        if not fence and not s.startswith("|"):
            for m in SENTENCE_END.finditer(line):
                add(at + m.end(), SENTENCE)
            for m in CLAUSE_END.finditer(line):
                add(at + m.end(), CLAUSE)
        at = end
    for m in SPACE.finditer(text):
        add(m.end(), BLANK)
    ends = [0, *sorted(best), len(text)]
    for a, b in zip(ends, ends[1:]):
        if b - a > max(1, limit // STRETCH):
            for pos in range(a + 1, b):
                add(pos, COMBINED if 0x300 <= ord(text[pos]) <= 0x36F or text[pos] in "\u200d\ufe0f" else NONE)
    pos = np.array([*sorted(best), len(text)])
    return pos, np.array([*(best[p] for p in pos[:-1]), 0.0])


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, half-open, in order."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    size = len(text)
    if size <= limit:
        return [(0, size)]
    pos, penalty = boundaries(text, limit)
    target = (size - overlap) / -(-(size - overlap) // (limit - overlap))
    cost, back = np.full(len(pos), np.inf), np.full(len(pos), -1)
    first = pos <= limit
    cost[first] = penalty[first] + IMBALANCE * ((pos[first] - overlap) / target - 1) ** 2
    cost[pos <= overlap] = np.inf  # a piece must get beyond what the next one repeats
    low = np.searchsorted(pos, pos - (limit - overlap))
    for j in range(len(pos)):
        i0 = low[j]
        if i0 < j:
            c = cost[i0:j] + IMBALANCE * ((pos[j] - pos[i0:j]) / target - 1) ** 2
            k = int(np.argmin(c))
            if c[k] + penalty[j] < cost[j]:
                cost[j], back[j] = c[k] + penalty[j], i0 + k
    ends, j = [], len(pos) - 1
    while j >= 0:
        ends.append(int(pos[j]))
        j = back[j]
    ends.reverse()
    return [(max(0, a - overlap), b) for a, b in zip([0, *ends], ends)]


def pieces(items: DataFrame, text_col: str, limit: int, overlap: int) -> DataFrame:
    """Every item longer than limit code points as its ordered pieces: all its other columns, with piece (from 0), start, end and
    text. Shorter items and null texts are left out. The text between start and end is the piece, and each starts overlap before
    the end of the one before. Columns of items that are named like the new ones give way to them."""
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    new = [StructField("piece", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]
    long = items.where(F.length(text_col) > limit)
    others = [c for c in items.columns if c != text_col and c not in ("piece", "start", "end", "text")]
    long = long.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, number, start, end, text = [], [], [], [], []
            for i, whole in enumerate(b.column(len(others)).to_pylist()):
                for k, (x, y) in enumerate(cuts(whole, limit, overlap)):
                    rows.append(i)
                    number.append(k)
                    start.append(x)
                    end.append(y)
                    text.append(whole[x:y])
            kept = b.select(list(range(len(others)))).take(pa.array(rows, pa.int64())) if others else None
            arrays = [pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept is not None else []), *arrays], names=[*others, "piece", "start", "end", "text"])

    return long.mapInArrow(run, StructType([*(long.schema[c] for c in others), *new]))


def limits(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    r = read(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    return r.max_size, r.overlap_size


def indexed(rows: DataFrame, limit: int, overlap: int) -> DataFrame:
    """All rows(span_row_id, paper_id, chunk_index, chunk) cut where needed: span_row_id, piece, pieces, start, end, text and a new chunk_index.

    Within a paper (in any spelling of its id) the chunks keep their order and the new indexes number the pieces of all its
    distinct chunks; equal chunks of one old index get equal new ones, different chunks never. Rows without a paper are
    numbered by themselves, a null chunk_index counts as the last. Null chunks come out as one null piece.
    """
    base = rows.select("span_row_id", F.coalesce(paper_key(F.col("paper_id")), F.concat(F.lit("\0"), F.col("span_row_id").cast("string"))).alias("paper"), F.coalesce("chunk_index", F.lit(2**31 - 1)).alias("old"), "chunk")
    base = base.withColumn("h", F.xxhash64("chunk"))
    cut = persist_table(pieces(base.select("span_row_id", "chunk"), "chunk", limit, overlap), "pieces")
    numbers = cut.groupBy("span_row_id").agg(F.count("*").cast("int").alias("pieces"))
    keyed = base.drop("chunk").join(numbers, "span_row_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    # a running total within the paper: totals of blocks of old indexes, then within the block
    units = persist_table(keyed.groupBy("paper", "old", "h").agg(F.max("pieces").alias("n")).withColumn("block", F.floor(F.col("old") / BLOCK)), "units")
    blocks = units.groupBy("paper", "block").agg(F.sum("n").alias("s"))
    blocks = blocks.select("paper", "block", (F.sum("s").over(Window.partitionBy("paper").orderBy("block")) - F.col("s")).alias("before"))
    within = Window.partitionBy("paper", "block").orderBy("old", "h")
    units = units.join(blocks, ["paper", "block"]).select("paper", "old", "h", (F.col("before") + F.sum("n").over(within) - F.col("n")).alias("base"))
    placed = keyed.join(units, (keyed.paper == units.paper) & (keyed.old == units.old) & keyed.h.eqNullSafe(units.h)).select("span_row_id", "pieces", "base")
    short = rows.where(F.col("chunk").isNull() | (F.length("chunk") <= limit))
    short = short.select("span_row_id", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("chunk").alias("end"), F.col("chunk").alias("text"))
    both = short.unionByName(cut)
    return both.join(placed, "span_row_id").select("span_row_id", (F.col("base") + F.col("piece")).alias("chunk_index"), "piece", "pieces", "start", "end", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out in several pieces."""
    limit, overlap = limits(spark, sf_dir, "chunk")
    cut = pieces(read(spark, sf_dir, "span_rows").select("span_row_id", "chunk"), "chunk", limit, overlap)
    return cut.where("piece = 1").select("span_row_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = limits(spark, sf_dir, "chunk")
    return indexed(read(spark, sf_dir, "span_rows").select("span_row_id", "paper_id", "chunk_index", "chunk"), limit, overlap)


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a chunk, rows in pieces, characters without what pieces repeat, pieces over the limit, pieces that don't repeat just the overlap
    of the one before, and new indexes of one paper that stand for different texts."""
    limit, overlap = limits(spark, sf_dir, "chunk")
    rows = read(spark, sf_dir, "span_rows").select("span_row_id", "paper_id", "chunk_index", "chunk")
    p = persist_table(indexed(rows, limit, overlap).where("text is not null").withColumn("h", F.xxhash64("text")).drop("text"), "invariants")
    before = F.lag("end").over(Window.partitionBy("span_row_id").orderBy("piece"))
    p = p.withColumn("wrong", (F.col("piece") > 0) & (before - F.col("start") != overlap))
    papers = rows.select("span_row_id", paper_key(F.col("paper_id")).alias("paper"))
    twice = p.join(papers, "span_row_id").where("paper is not null").groupBy("paper", "chunk_index").agg(F.count_distinct("h").alias("c")).where("c > 1").count()
    size = F.col("end") - F.col("start") - F.when(F.col("piece") > 0, F.lit(overlap)).otherwise(0)
    return p.agg(
        F.count_if(F.col("piece") == 0).alias("rows_cut"), F.count_if(F.col("piece") == 1).alias("rows_in_pieces"), F.sum(size).cast("bigint").alias("characters"),
        F.count_if(F.col("end") - F.col("start") > limit).alias("over_limit"), F.count_if("wrong").alias("wrong_overlaps"), F.lit(twice).cast("bigint").alias("ambiguous_indexes"),
    )
