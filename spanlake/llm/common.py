"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that stand for "no value" in key columns, in lower case (fixed values).
FILLERS = ("none", "null", "nil", "nan", "na", "n/a", "n.a.", "unknown", "undefined", "missing", "tbd", "todo", "-", "--", "?")

WORDS = r"[^\W_]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spanlake-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the following joins real sizes. The files go when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p.getParent())
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of persist_table as soon as nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(parent)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trimmed(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def query_key(c: Column) -> Column:
    """A question in lower case, white space runs as one blank, without outer white space and final ? . !; null if nothing is left or it is a filler word."""
    t = F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"^ +|[ ?.!]+$", "")
    return F.when((t != "") & ~t.isin(*FILLERS), t)


def paper_key(c: Column) -> Column:
    """A paper id in one spelling: no outer white space, lower case, without scheme, host, .pdf and final slash; null for blank and filler words."""
    t = F.lower(trimmed(c))
    t = F.regexp_replace(t, r"^(https?://)?(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}/(.*/)?(?=[^/])", "")
    t = F.regexp_replace(t, r"/+$", "")
    t = F.regexp_replace(t, r"\.pdf$", "")
    t = trimmed(t)
    return F.when((t != "") & ~t.isin(*FILLERS), t)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def objects(df):
    """A pandas frame for Arrow: strings as plain objects, as an empty Arrow-backed string column has no chunk to send."""
    return df.astype({c: object for c, t in df.dtypes.items() if t.name in ("str", "string")})
