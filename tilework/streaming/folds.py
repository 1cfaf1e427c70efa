"""Folds over tiles that arrive: the state is a running best, so slices may come in any order and any number of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tilework.operators.tables import new_folder


def running_max(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Maximum projection of a stream of pixels."""
    return stream.groupBy(*keys).agg(F.max("v").alias("v"))


def running_first(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the last generation to arrive for each key: stale results lose."""
    return stream.groupBy(*keys).agg(F.max_by("v", "generation").alias("v"))


def drained(spark: SparkSession, result: DataFrame) -> DataFrame:
    """Runs a stream of whole results over what is there now and returns the last one. Executors write it into a folder that they
    share; the driver gets no rows."""
    folder = new_folder(spark)
    kept(result, folder, mode="complete").awaitTermination()
    rows = spark.read.schema(StructType([*result.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/updates")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")


# ---- focus of slices as they arrive


def focus_fold(slices: DataFrame, keys: list[str], window: int = 5) -> DataFrame:
    """The sharpest pixels of each key's slices so far, for a stream of slices(keys, generation, z, h, w, v: array), a row a slice.

    State, a key: generation, number of slices, and for each pixel the best sharpness, its value and its z. The best is by
    sharpness, then by the smaller z, so neither the order of slices nor their batches matter. A slice of an older generation is
    stale and dropped; the first of a newer one starts anew. Gives in update mode (keys, generation, slices, h, w, v, z: array);
    the row with the greatest (generation, slices) of a key is its latest."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in slices.schema}
    lead = ", ".join(f"{k} {kinds[k]}" for k in keys)
    names = [*keys, "generation", "slices", "h", "w", "v", "z"]

    def fold(key: tuple, parts, state: GroupState):
        import numpy as np
        import pandas as pd

        from tilework.operators.planes import box_mean, image
        from tilework.operators.registration import plane_laplacian

        held = None
        if state.exists:
            generation, n, h, w, *raw = state.get
            held = (generation, n, h, w, *(np.frombuffer(r, kind).reshape(h, w).copy() for r, kind in zip(raw, (np.float64, np.float32, np.int32))))
        changed = False
        for part in parts:
            for s in part.itertuples(index=False):
                if held is not None and s.generation < held[0]:
                    continue
                plane = image(s.v, s.h, s.w)
                sharp = box_mean(plane_laplacian(plane) ** 2, window)
                z = np.full(plane.shape, s.z, np.int32)
                if held is None or s.generation > held[0]:
                    held = (int(s.generation), 1, *plane.shape, sharp, plane.astype(np.float32), z)
                else:
                    generation, n, h, w, best, value, index = held
                    better = (sharp > best) | ((sharp == best) & (z < index))
                    best[better], value[better], index[better] = sharp[better], plane[better], z[better]
                    held = (generation, n + 1, h, w, best, value, index)
                changed = True
        if changed:
            generation, n, h, w, best, value, index = held
            state.update((generation, n, h, w, best.tobytes(), value.astype(np.float32).tobytes(), index.astype(np.int32).tobytes()))
            yield pd.DataFrame([(*key, generation, n, h, w, value.ravel(), index.ravel())], columns=names)

    return slices.groupBy(*keys).applyInPandasWithState(fold, f"{lead}, generation int, slices int, h int, w int, v array<float>, z array<int>", "generation int, slices int, h int, w int, best binary, value binary, at binary", "update", GroupStateTimeout.NoTimeout)


def kept(stream: DataFrame, folder: str, trigger: dict | None = None, mode: str = "update"):
    """Starts a stream of updates whose rows executors write below folder, a batch a directory of its own: a batch that runs
    twice leaves one. The driver gets no rows."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The latest row of each key that kept has written."""
    rows = spark.read.parquet(f"{folder}/updates").drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("generation", "slices")).alias("r")).select(*keys, "r.*")
