"""Sinks: JSON lines, resumable appends, split folders, sheets and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_pending(rows: DataFrame, path: str, keys: list[str], transform) -> None:
    """Run transform on the rows whose keys aren't in the table at path yet and append its result; a null key is always pending."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(done, keys, "left_anti")
    transform(rows).write.mode("append").parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, and the number of rows of each as one JSON file."""
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    df.groupBy(split).count().coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet in folders config=/split=."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/config={name}")


def highlighted(chunk, spans):
    """The chunk with its spans in capitals; spans from the last to the first, so that offsets hold."""
    order = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"]))))
    up = lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.upper(F.substring(acc, s["start"] + 1, s["end"] - s["start"])), F.substring(acc, s["end"] + 1, F.length(acc)))
    return F.aggregate(order, chunk, up)


def annotation_sheet(hits: DataFrame, path: str) -> None:
    """hits(query, rank, title, url, chunk_number, chunk) as a sheet, a blank row after each query."""
    cols = ["query", "rank", "title", "url", "chunk_number", "chunk"]
    last = F.lead("rank").over(Window.partitionBy("query").orderBy("rank")).isNull()
    text = hits.select("query", "rank", *[F.col(c).cast("string").alias(f"_{c}") for c in cols], last.alias("last"))
    text = text.withColumn("blank", F.explode(F.when(F.col("last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = text.repartitionByRange("query").sortWithinPartitions("query", "rank", "blank").select(*[F.when(F.col("blank") == 0, F.col(f"_{c}")).alias(c) for c in cols])
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_markdown(df: DataFrame, path: str) -> None:
    """One .md file per id below a folder that all executors share, written by the tasks."""

    def save(rows) -> None:
        import os

        os.makedirs(path, exist_ok=True)
        for r in rows:
            with open(os.path.join(path, f"{r.anthology_id}.md"), "w", encoding="utf-8") as f:
                f.write(r.markdown or "")

    df.select("anthology_id", "markdown").foreachPartition(save)
