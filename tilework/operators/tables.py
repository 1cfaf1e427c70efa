"""Tables in the folder that all executors share: what several steps read is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below spark.checkpoint.dir (or the context's checkpoint folder). A local master without either uses a
    temporary folder; any other is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tilework-")
    return f"{folder.rstrip('/')}/tilework-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written into a new shared folder and read back. Tables stay until the folder is cleared."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
