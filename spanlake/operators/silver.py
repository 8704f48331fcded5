"""Silver labels: candidates, records, quality filter, negatives and group splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


#: Fixed value: a chunk is of a reference section if its heading stands within so many characters; the rule itself looks no further.
HEAD = 2500


@dataclass(frozen=True)
class Quality:
    """What a positive row must hold to stay: words of its spans within `words`, `per_word` citations and years at most, a rank up to `deepest`
    (None: any), and no caption if `captions` is False."""

    # The defaults decide which rows drop.
    words: tuple[int, int] = (6, 220)
    per_word: tuple[float, float] = (0.12, 0.08)
    deepest: int | None = None
    captions: bool = True


def drop_reason(label: Column, spans: Column, source: Column, rank: Column, chunk: Column, quality: Quality = Quality()) -> Column:
    """Why a positive row is dropped, the first reason in a fixed order; null for rows that stay. Negative rows always stay."""
    text = T.stripped(F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "\n"))
    words = T.word_count(text)
    out = F.when(F.coalesce(label, F.lit(0)) != 1, F.lit(None).cast("string")).when(F.coalesce(F.size(spans), F.lit(0)) == 0, "positive_without_spans")
    if quality.deepest is not None:
        out = out.when((source == "retrieved") & (rank > quality.deepest), "rank_too_deep")
    out = out.when(words < quality.words[0], "span_too_short").when(words > quality.words[1], "span_too_long")
    out = out.when(T.is_reference_like(text) | T.is_reference_like(F.substring(chunk, 1, HEAD)), "reference_section")
    if not quality.captions:
        out = out.when(T.is_caption_like(text), "caption_like")
    return out.when(T.density(text, T.CITATION) > quality.per_word[0], "citation_dense").when(T.density(text, T.YEAR) > quality.per_word[1], "year_dense")


def candidates(runs: DataFrame, top_n: int) -> DataFrame:
    """Per run row the gold chunk first (rank null), then the first top_n hits that aren't it, with their own ranks."""
    keys = ["run_row_id", "query", "gold_paper", "gold_chunk"]
    gold = runs.where("gold_paper is not null and gold_chunk is not null").select(*keys, F.col("gold_paper").alias("paper_id"), F.col("gold_chunk").alias("chunk_index"), F.lit(None).cast("int").alias("retrieval_rank"), F.lit("gold").alias("source"))
    others = runs.select(*keys, F.posexplode(F.slice("results", 1, top_n)).alias("pos", "hit")).select(
        *keys, F.col("hit.document_id").alias("paper_id"), F.col("hit.chunk_number").alias("chunk_index"), (F.col("pos") + 1).alias("retrieval_rank"), F.lit("retrieved").alias("source")
    )
    same = F.col("paper_id").eqNullSafe(F.col("gold_paper")) & F.col("chunk_index").eqNullSafe(F.col("gold_chunk"))
    return gold.unionByName(others.where(~same))


def hashed(seed: int, *keys: Column) -> Column:
    """An order that any engine can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def group_split(rows: DataFrame, keys: list[str], fraction: float = 0.1, seed: int = 1337) -> DataFrame:
    """rows with split train or dev: whole groups, the first max(1, round(n * fraction)) groups in hashed order are dev. Null is a key like any other.

    Only distinct groups are ranked; their running number is taken in hash ranges, so no task sees all groups.
    """
    h = hashed(seed, *[F.col(k) for k in keys])
    groups = rows.select(h.alias("h")).distinct().withColumn("r", F.substring("h", 1, 2))
    per = groups.groupBy("r").agg(F.count("*").alias("c"))  # 256 rows
    total = per.agg(F.sum("c").alias("n"))
    before = per.select("r", (F.sum("c").over(Window.orderBy("r")) - F.col("c")).alias("before"))
    ranked = groups.join(F.broadcast(before), "r").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("r").orderBy("h")))
    dev = ranked.crossJoin(F.broadcast(total)).where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fraction)))).select("h", F.lit("dev").alias("dev"))
    return rows.withColumn("h", h).join(dev, "h", "left").withColumn("split", F.coalesce("dev", F.lit("train"))).drop("h", "dev")


def block_rank(rows: DataFrame, group: str, h: str, ties: str) -> DataFrame:
    """rows with rank: the place of each row within its group in the order of a hex hash column (then ties). Counts of 256 hash ranges
    per group give each range its first rank, so that no task ranks a whole hot group. Null is a group like any other."""
    x = rows.withColumn("_r", F.substring(h, 1, 2))
    counts = x.groupBy(F.col(group).alias("_g"), F.col("_r").alias("_s")).agg(F.count("*").alias("_c"))
    before = counts.select("_g", "_s", (F.sum("_c").over(Window.partitionBy("_g").orderBy("_s")) - F.col("_c")).alias("_b"))
    within = F.row_number().over(Window.partitionBy(group, "_r").orderBy(h, ties))
    ranked = x.withColumn("_n", within)
    return ranked.join(before, ranked[group].eqNullSafe(before["_g"]) & (ranked["_r"] == before["_s"])).withColumn("rank", F.col("_b") + F.col("_n")).drop("_r", "_g", "_s", "_b", "_n")


def negatives(rows: DataFrame, query: str, label: str, item: str, ratio: int, seed: int = 1337) -> DataFrame:
    """All positives, and per query min(#negatives, ratio * #positives) negatives in hashed order. A null label counts as negative."""
    known = rows.select(F.col(query).alias("q"), F.col(item).alias("i"), F.coalesce(label, F.lit(False)).alias("y"))
    count = known.where("y").groupBy(F.col("q").alias("_q")).agg(F.count("*").alias("positives"))
    neg = block_rank(known.where("not y").withColumn("h", hashed(seed, F.col("q"), F.col("i"))), "q", "h", "i")
    kept = neg.join(count, F.col("q").eqNullSafe(F.col("_q"))).where(F.col("rank") <= F.col("positives") * ratio)
    both = known.where("y").select("q", "i", "y").unionByName(kept.select("q", "i", "y"))
    return both.select(F.col("q").alias(query), F.col("i").alias(item), F.col("y").alias(label))


def per_group_sample(rows: DataFrame, group: str, item: str, n: int, seed: int = 1337) -> DataFrame:
    """n items of each group in hashed order; all where there are fewer. The constant limit prunes each task before the shuffle."""
    w = Window.partitionBy(group).orderBy(hashed(seed, F.col(item)), F.col(item))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet; rows with a null key are always pending."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def records(candidates_with_spans: DataFrame) -> DataFrame:
    """Silver records of candidates(..., source, answerable, spans): label 1 for gold chunks and answerable ones, spans only with label 1."""
    label = ((F.col("source") == "gold") | F.coalesce(F.col("answerable"), F.lit(False))).cast("int")
    kind = candidates_with_spans.schema["spans"].dataType
    spans = F.when(label == 1, F.coalesce("spans", F.array().cast(kind))).otherwise(F.array().cast(kind))
    return candidates_with_spans.withColumns({"label": label, "spans": spans})


def generative_examples(rows: DataFrame, most: int = 10) -> DataFrame:
    """prompt and response of rows(question, chunk, label, spans): the response is JSON with at most `most` span texts."""
    texts = F.slice(F.coalesce(F.transform("spans", lambda s: s["text"]), F.array().cast("array<string>")), 1, most)
    shown = F.when(F.coalesce(F.col("label"), F.lit(0)) == 1, texts).otherwise(F.array().cast("array<string>"))
    prompt = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\n\nText:\n"), F.coalesce("chunk", F.lit("")), F.lit("\n\nQuote the passages that answer the question."))
    return rows.select(prompt.alias("prompt"), F.to_json(F.struct((F.size(shown) > 0).alias("answerable"), shown.alias("spans"))).alias("response"))


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int = 1337) -> DataFrame:
    """n rows in hashed order of a key."""
    return rows.withColumn("_h", hashed(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")
