"""Several tables written as one: all are staged and checked, and one small manifest makes them visible together."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed order: the columns of the edge report.
EDGE_COLUMNS = ["axis", "a", "b", "accepted", "stage_dy", "stage_dx", "ncc", "psr", "peak_margin", "texture"]


def write_together(tables: dict[str, DataFrame], path: str, gate: Callable[[], None] = lambda: None) -> None:
    """Writes each table below path, reads it back, and only if every schema and row count agrees points the manifest at them.
    A failure leaves what readers see as it was. gate is called before each step and may stop it with an error."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        gate()
        place = f"{path}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(place)
        back = spark.read.parquet(place)
        if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"{name} was not written as it was")
        rows.append((name, place, back.count()))
    gate()
    spark.createDataFrame(rows, "name string, place string, n long").coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")


def read_together(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last complete write."""
    manifest = spark.read.parquet(f"{path}/manifest")
    last = manifest.agg(F.max("at")).first()[0]
    return {r["name"]: spark.read.parquet(r["place"]) for r in manifest.where(F.col("at") == F.lit(last)).collect()}


def write_edges_csv(edges: DataFrame, path: str) -> None:
    """The edge report: fixed columns, 0 or 1 for accepted, nothing for null."""
    edges.select(*EDGE_COLUMNS).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files(name, content) into a folder that all executors share and gives (path, bytes). Each task writes under a name of
    its own and renames, so a reader sees whole files only and a task that runs twice leaves one."""
    import uuid

    import pandas as pd
    from pyarrow import fs

    def put(parts):
        for part in parts:
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            rows = []
            for name, content in zip(part["name"], part["content"]):
                hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content)
                store.move(hidden, f"{root}/{name}")
                rows.append((f"{folder}/{name}", len(content)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return files.select("name", "content").mapInPandas(put, "path string, bytes long")
