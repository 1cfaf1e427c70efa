"""What several operators share: table access, staged tables, broadcast bounds and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word definitions here: space, tab to carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
#: Rows up to which a side is broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: few rows in an Arrow batch keep Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or its checkpoint folder; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/tilework-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Joins right by broadcast if it has at most BROADCAST_ROWS rows, else by shuffle (where AQE splits skewed keys)."""
    n = right.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("merge"), on, how)


def words(text: Column) -> Column:
    """The words of text as an array; null and blank texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RE))


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """(node, comp) for edges (u, v): comp is the smallest node reachable. Alternates large and small stars, so that hubs
    stay spread over tasks (minima are aggregated before the shuffle; AQE splits hot join keys) and rounds grow with the
    logarithm of the longest path."""
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(limit):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = staged(small.union(small_low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return found.union(found.select(F.col("comp").alias("node"), "comp").distinct())
