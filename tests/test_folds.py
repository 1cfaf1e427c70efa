"""Slices that arrive in any order and batches give what a whole stack gives; stale ones are dropped."""

import numpy as np
import pandas as pd
import pytest

from tilework.operators import planes as P
from tilework.operators import wells
from tilework.streaming import folds

SCHEMA = "k string, generation int, z int, h int, w int, v array<double>"


def run(spark, tmp_path, name, batches):
    source = tmp_path / name
    source.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame([(k, g, z, *p.shape, p.ravel().tolist()) for k, g, z, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"part{n:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    folder = f"file://{tmp_path}/{name}_out"
    folds.kept(folds.focus_fold(stream, ["k"]), folder).awaitTermination()
    return {r.k: r for r in folds.latest(spark, folder, ["k"]).collect()}


@pytest.fixture(scope="module")
def stacks():
    rng = np.random.default_rng(7)
    out = {}
    for key in "ab":
        base = [rng.integers(0, 200, (24, 28)).astype(float) for _ in range(4)]
        base[3] = base[1].copy()  # a tie everywhere: the smaller z wins
        out[key] = base
    return out


def truth(stack):
    sharp = np.stack([P.box_mean(wells.plane_laplacian(p) ** 2, 5) for p in stack])
    z = sharp.argmax(axis=0)
    return np.take_along_axis(np.stack(stack), z[None], 0)[0], z


def test_any_order_and_batching(spark, tmp_path, stacks):
    rows = [(k, 1, z, p) for k, stack in stacks.items() for z, p in enumerate(stack)]
    orders = {"one": [rows], "turned": [rows[::-1]], "many": [[r] for r in rows[::-1]], "mixed": [rows[5:], rows[:2], rows[2:5]]}
    for name, batches in orders.items():
        got = run(spark, tmp_path, name, batches)
        for key, stack in stacks.items():
            value, z = truth(stack)
            assert got[key].slices == 4 and (P.image(got[key].v, 24, 28) == value).all() and (P.image(got[key].z, 24, 28) == z).all()


def test_stale_slices_are_dropped(spark, tmp_path, stacks):
    a, b = stacks["a"], stacks["b"]
    got = run(spark, tmp_path, "stale", [[("k", 1, 0, a[0])], [("k", 2, 0, b[0]), ("k", 1, 1, a[1])], [("k", 1, 2, a[2])], [("k", 2, 1, b[1])], [("k", 0, 3, a[3])]])
    value, z = truth(b[:2])
    assert (got["k"].generation, got["k"].slices) == (2, 2) and (P.image(got["k"].v, 24, 28) == value).all() and (P.image(got["k"].z, 24, 28) == z).all()


def test_last_generation_of_a_pixel(spark):
    frame = spark.createDataFrame(pd.DataFrame({"y": [0, 0, 1], "generation": [2, 1, 1], "v": [7, 9, 3]}))
    assert sorted(map(tuple, folds.running_first(frame, ["y"]).collect())) == [(0, 7), (1, 3)]
