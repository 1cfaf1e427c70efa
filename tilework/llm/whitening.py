"""Embedding whitening on exact integer sums.

Each entry c becomes the long x = floor(SCALE * c) + SHIFT. Tasks sum X and X'X exactly and together they give, without a
rounding, C = n * X'X - S S', which is n * n times the covariance. Only then is it divided (Python's division of whole numbers
rounds once) and decomposed by eigh. C does not change if a constant is taken from x, so sums are taken of x - SHIFT, whose
digits are few.

A batch of rows is summed by matrix products of digits of 20 bits as doubles: up to 4,096 rows at a time, each product and sum
stays below 2**52, so the products are exact. Sums of batches are Python's whole numbers. A task gives its sums in digits of
32 bits; Spark adds them digit by digit, and the driver carries them over. What it gets is the triangle of X'X: its size
follows the dimension, never the rows (MOST_DIMENSIONS bounds it).

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of
another length than most have (of equally many, the longer). An x outside +-2**62 counts as that end. Repeated rows are rows of
their own, null ids stay, other columns are not read. A component without variance (e at most d * 2**-50 of the
greatest e) gives whitened 0, and identity_error leaves it out; so do all if n = 1. deviation is exact; where it passes
a long it is null, and deviation_exact, a string of digits, holds it always. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import staged, table

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
MOST_DIMENSIONS = 8192
DIGIT = 20
ROWS = 4096
LIMBS = 8


@dataclass
class Fit:
    """n, exact sums of x - SHIFT, eigenvectors (columns) by falling eigenvalue, eigenvalues, and the trace of V."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector is whole: array<double>, finite entries, the most frequent length."""
    v = F.col(column).cast("array<double>")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    good = vectors.select(F.col(id_column).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return good.where("false")
    if lengths[0]["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of over {MOST_DIMENSIONS} dimensions: their covariance does not fit the driver")
    return good.where(F.size("v") == lengths[0]["d"])


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """x - SHIFT of a batch with column v, a row a vector."""
    v = batch.column(batch.schema.get_field_index("v"))
    flat = v.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -(2.0**62), 2.0**62).astype(np.int64).reshape(batch.num_rows, -1)


def products(y: np.ndarray) -> np.ndarray:
    """Y'Y exactly, as an object array of whole numbers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        rest, digits = y[at : at + ROWS], []
        while True:
            low = ((rest + (1 << DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << DIGIT - 1)  # signed digit
            digits.append(low.astype(np.float64))
            rest = (rest - low) >> DIGIT
            if not rest.any():
                break
        for i, a in enumerate(digits):
            for j, b in enumerate(digits[: i + 1]):
                got = (a.T @ b).astype(np.int64)
                got = got if i == j else got + got.T
                total = total + (got.astype(object) << DIGIT * (i + j) if i + j else got.astype(object))
    return total


def _limbs(value: int) -> list[int]:
    """Digits of 32 bits, the last one signed."""
    return [value >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums, square = 0, None, None
    for batch in batches:
        if batch.num_rows:
            y = integers(batch)
            s, q = y.astype(object).sum(axis=0) if np.abs(y).max() >> 40 else y.sum(axis=0).astype(object), products(y)
            n, sums, square = n + len(y), s if sums is None else sums + s, q if square is None else square + q
    if n:
        d = len(sums)
        i, j = np.triu_indices(d)
        where = [(-1, -1), *((-1, k) for k in range(d)), *zip(i.tolist(), j.tolist())]
        values = [n, *map(int, sums), *map(int, square[i, j])]
        digits = np.array([_limbs(v) for v in values], np.int64)
        at = np.array(where, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), *[pa.array(digits[:, k].copy()) for k in range(LIMBS)]], ["i", "j", *[f"l{k}" for k in range(LIMBS)]])


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, C) of rows(v): exact sums of x - SHIFT, and C = n * X'X - S S'."""
    digits = [f"l{k}" for k in range(LIMBS)]
    parts = rows.select("v").mapInArrow(_partial, "i int, j int, " + ", ".join(f"{c} long" for c in digits))
    got = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in digits]).collect()  # a row an entry of the triangle
    sums = {(r["i"], r["j"]): sum(r[c] << 32 * k for k, c in enumerate(digits)) for r in got}
    n = sums.get((-1, -1), 0)
    d = sum(i == -1 and j >= 0 for i, j in sums)
    s = [sums[-1, k] for k in range(d)]
    return n, s, [[n * sums[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def fit(rows: DataFrame) -> Fit | None:
    """The whitening of rows(v); None without rows. The largest entry of each eigenvector is positive."""
    n, sums, c = scatter(rows)
    if not n:
        return None
    v = np.array([[entry / (n * n) for entry in row] for row in c])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Fit(n, sums, vectors * np.where(sign == 0, 1, sign), values, sum(c[k][k] for k in range(len(c))) / (n * n))


def has_variance(f: Fit) -> np.ndarray:
    return f.values > len(f.values) * 2.0**-50 * max(f.values[0], 0.0)


def project(rows: DataFrame, f: Fit, k: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation, deviation_exact, w (up to k whitened numbers) of each row of rows(vec_id, v)."""
    n, sums = f.n, np.array(f.sums, object)
    k = min(k, len(f.values))
    live = has_variance(f)[:k]
    scale = np.where(live, 1 / (n * np.sqrt(np.where(live, f.values[:k], 1.0))), 0.0)
    turn = f.vectors[:, :k] * scale
    small = max(map(abs, f.sums), default=0) < 2**62

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(batch)
            top = int(np.abs(y).max()) if y.size else 0
            if small and n * top < 2**62 and (2 * max(n * top, max(map(abs, f.sums)))) ** 2 * len(f.sums) < 2**63:
                away = n * y - sums.astype(np.int64)
                squares = (away * away).sum(axis=1).tolist()
            else:
                away = y.astype(object) * n - sums
                squares = (away * away).sum(axis=1).tolist()
            w = away.astype(np.float64) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s if s < 2**63 else None for s in squares], pa.int64()), pa.array([str(s) for s in squares]), lists], ["vec_id", "deviation", "deviation_exact", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(of, f"vec_id {kind}, deviation long, deviation_exact string, w array<double>")


def identity_error(whitened: DataFrame, live: np.ndarray) -> float:
    """The largest entry of the covariance of whitened(w) less the identity, over the components with variance."""
    at = [k for k in range(len(live)) if live[k]]
    pairs = [(i, j) for i in at for j in at if i <= j]
    if not pairs:
        return 0.0
    got = whitened.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs))


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact for each whole row of
    vectors and each of the first k components."""
    rows = whole(vectors, id_column, column)
    f = fit(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if f is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    done = staged(project(rows, f, k), "whitened")
    error = identity_error(done, has_variance(f)[:k])
    shares = [max(float(e), 0.0) / f.trace if f.trace > 0 else 0.0 for e in f.values[:k]]
    out = done.select("vec_id", "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1)
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
