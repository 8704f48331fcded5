"""Scans: JSON lines, prediction files of several shapes, annotation sheets, folders of texts and questions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped. strict: a malformed line fails the job instead of giving nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n physical lines of a file: an ordered limit, not a scan of the whole file."""
    return spark.read.text(path).limit(n)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file, or a folder of them, as JSON lines, a JSON list, an object with records, or one object; the shape is found per file from
    its first line. Lines are split among tasks and never dropped: a malformed one gives a row with its text in `error`."""
    import json

    def is_line(text: str) -> bool:
        try:
            return isinstance(d := json.loads(text), dict) and "records" not in d
        except ValueError:
            return False

    lines, whole = [], []
    for f in sorted(spark.read.text(path).inputFiles()):  # files, not rows
        first = spark.read.text(f).where(F.trim("value") != "").first()
        if first is not None:
            (lines if is_line(first[0]) else whole).append(f)
    ddl = schemas.PREDICTION
    names = [c.name for c in spark.createDataFrame([], ddl).schema]
    out = spark.createDataFrame([], ddl)
    if lines:
        bad = F.when(F.col("malformed").isNotNull(), F.concat(F.lit("malformed: "), F.col("malformed"))).otherwise(F.col("error"))
        rows = spark.read.schema(f"{ddl}, malformed STRING").option("columnNameOfCorruptRecord", "malformed").json(lines)
        out = out.unionByName(rows.withColumn("error", bad).select(*names))
    if whole:
        docs = spark.read.schema(f"{ddl}, records ARRAY<STRUCT<{ddl}>>").option("multiLine", True).option("mode", "FAILFAST").json(whole)
        own = F.struct(*[F.col(c) for c in names])
        out = out.unionByName(docs.select(F.explode(F.coalesce("records", F.array(own))).alias("r")).select("r.*"))
    return out


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, run_name, summary): the numbers a run file has under `summary`, null where it has none and the run must be scored from its records."""
    docs = spark.read.schema("run_name STRING, summary MAP<STRING, DOUBLE>").option("multiLine", True).json(path)
    return docs.select(F.col("_metadata.file_path").alias("file"), "run_name", "summary").groupBy("file").agg(F.first("run_name", True).alias("run_name"), F.first("summary", True).alias("summary"))


def rows_until(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A published table, lazily, with at most `limit` rows if one is given."""
    df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation sheets: blank rows skipped, fewer than nine fields fail, gold text split at blank lines."""
    raw = spark.read.schema(schemas.ANNOTATION).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    some = raw.where(F.coalesce(*[F.when(F.trim(c) != "", F.lit(1)) for c in raw.columns]).isNotNull())
    checked = some.withColumn("url", F.when(F.col("url").isNull(), F.raise_error(F.concat(F.lit("annotation row without its fields: "), F.coalesce("query", F.lit(""))))).otherwise(F.col("url")))
    parts = F.filter(F.transform(F.split(F.coalesce("gold_extraction", F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return checked.withColumns({"rank": F.col("rank").cast("int"), "chunk_number": F.col("chunk_number").cast("int"), "gold_extraction": parts, "relevance_label": F.coalesce("relevance_label", F.lit("")), "extraction_label": F.coalesce("extraction_label", F.lit(""))})


def stem(c) -> object:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(anthology_id, markdown): every .md file below a folder; of equal names the first path. Bytes that aren't UTF-8 are replaced."""
    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return pd.Series([bytes(x).decode("utf-8", "replace") for x in b], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    first = files.groupBy(stem(F.col("path")).alias("anthology_id")).agg(F.min("path").alias("path"))
    return files.join(first, "path").select("anthology_id", decode("content").alias("markdown"))


def questions_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of a folder of per-paper files, the file's name being the paper; chunks without questions are skipped."""
    chunks = spark.read.schema(schemas.QUESTIONS).json(path, recursiveFileLookup=True).select("*", stem(F.col("_metadata.file_path")).alias("paper"))
    return chunks.where("size(qa) > 0").select("paper", "chunk_index", "chunk", F.explode("qa").alias("q")).select("paper", "chunk_index", "chunk", "q.*")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Type STRING, Definition STRING, Examples ARRAY<STRING>").option("multiLine", True).json(path)


def paired_lists(c, fields: list[str]):
    """A struct of lists as a list of structs, short lists padded with nulls."""
    return F.arrays_zip(*[c[f].alias(f) for f in fields])
