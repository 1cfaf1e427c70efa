"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Vectors are scaled to length 1, where the largest cosine is the least distance. Each of TABLES tables hashes a vector by
DIRECTIONS Gaussian (2-stable) projections cut into SLOTS slots of WIDTH; the slots together are its bucket. For a neighbour
at cosine c a projection is normal around c times the query's, with variance 1 - c * c, so the chance of each slot is known,
and so is the share of all rows that each slot holds (counted over the table). A query visits buckets in the order of their
estimated success for a row scored: the neighbour's chance over the share of rows. It goes on until the neighbour lies in a
visited bucket with chance MASS; that point is read off DRAWS drawn neighbours. Candidates of all tables are merged and
ranked by the exact cosine of the original vectors in double precision.

Buckets lie on pages that agree in the first slots, about PAGE rows each, so the number of pages follows the number of rows;
a query is sent to the likeliest pages until only LEFT_OUT of its chance is missing, and tells buckets apart there. A page
gives what lies within REACH times the gap 1 - c that it was probed for; what is farther says nothing about the nearest. In the
first round c is the lower quartile of the cosines of the K-th neighbours of CALIBRATING queries, found by one scan. A query
with fewer than K rows found is probed again for the least of these cosines, then for half of it and so on, in the end for 0,
where all buckets are alike, all are visited and every row is given.

Every row is indexed. Equal vectors are searched once: of these only the K + 1 smallest ids can be among the K nearest to
anything. Large pages are split by row, and by query, into blocks of BLOCK, each block of rows meeting each block of
queries, so no task holds a whole page and none is cut.

Defined results: vectors that are null, zero, of another length than most, or that hold nulls or non-finite values take no
part, nor do null ids; rows with the same id and vector count once, and a row never finds its own id; fewer than K
candidates give as many rows; ties go to the smaller id. Vectors of any magnitude are scaled by a power of two first."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.llm.common import BROADCAST_ROWS, joined, staged, table

K = 5
TABLES = 4
DIRECTIONS = 32
WIDTH = 1.0
SLOTS = 6
MASS = 0.55
DRAWS = 256
LEFT_OUT = 0.02
REACH = 1.1
PAGE = 2000
CALIBRATING = 64
BLOCK = 4000
NEAR = 0.9995
SEED = 11


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v): v holds doubles."""
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    df = df.where(good)
    size = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return df.where(F.size("v") == (size["n"] if size else 0)).distinct()


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes: floats where these hold the doubles exactly."""
    small = x.astype(np.float32)
    exact = bool((small.astype(float) == x).all())
    x = np.ascontiguousarray(small if exact else x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _unpacked(col, dim: int) -> np.ndarray:
    out = np.empty((len(col), dim))
    for i, raw in enumerate(col):
        out[i] = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim else np.float64)
    return out


def _hashing(dim: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, t))
    return rng.normal(size=(dim, DIRECTIONS)), rng.uniform(0, WIDTH, DIRECTIONS)


def _slots(y: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((y + shift) / WIDTH) + SLOTS // 2, 0, SLOTS - 1).astype(np.int64)


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-4: enough to order buckets."""
    return 1 / (1 + np.exp(-1.5976 * z - 0.070566 * z**3))


def _chances(y: np.ndarray, c: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Of each slot, for a neighbour at cosine c of a query projected to y: query, direction, slot."""
    edge = (np.arange(SLOTS + 1) - SLOTS // 2) * WIDTH - shift[:, None]
    z = (edge[None] - (c[:, None] * y)[:, :, None]) / np.sqrt(1 - c * c)[:, None, None]
    z[:, :, 0], z[:, :, -1] = -9, 9
    return np.maximum(np.diff(_normal(np.clip(z, -9, 9)), axis=2), 1e-9)


def _gains(chance: np.ndarray, shares: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Logarithm of the neighbour's chance over the share of rows; for c = 0 nothing is told apart."""
    return np.where((c > 0)[:, None, None], np.log(chance) - np.log(shares)[None], 0.0)


def _least_gain(gains: np.ndarray, y: np.ndarray, c: np.ndarray, shift: np.ndarray, mass: float) -> np.ndarray:
    """The gain down to which buckets are visited, so that a share mass of drawn neighbours lies in them."""
    draws = np.random.default_rng(SEED).normal(size=(DRAWS, DIRECTIONS))
    out = np.empty(len(y))
    for i in range(len(y)):
        at = _slots(c[i] * y[i] + draws * math.sqrt(1 - c[i] ** 2), shift)
        out[i] = np.quantile(gains[i][np.arange(DIRECTIONS), at].sum(axis=1), 1 - mass)
    return out


def _pages(chance: np.ndarray, n: int) -> np.ndarray:
    """The likeliest pages, told by the first n slots, until LEFT_OUT of the chance is missing. Prefixes grow slot by slot."""
    page, p = np.zeros(1, np.int64), np.ones(1)
    for j in range(n):
        page = (page[:, None] * SLOTS + np.arange(SLOTS)).ravel()
        p = (p[:, None] * chance[j]).ravel()
        order = np.argsort(-p, kind="stable")
        order = order[: int(np.searchsorted(np.cumsum(p[order]), 1 - LEFT_OUT * (j + 1) / n)) + 1]
        page, p = page[order], p[order]
    return page


def _page_of(slots: np.ndarray, n: int) -> np.ndarray:
    return slots[:, :n] @ (SLOTS ** np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(len(slots), np.int64)


def _counted(batches):
    """Rows in each slot: table, direction, slot, rows."""
    total = None
    for b in batches:
        x = _matrix(b.column(0))
        if not len(x):
            continue
        total = np.zeros((TABLES, DIRECTIONS, SLOTS), np.int64) if total is None else total
        unit = _unit(x)
        for t in range(TABLES):
            a, shift = _hashing(x.shape[1], t)
            slots = _slots(unit @ a, shift)
            total[t] += np.stack([np.bincount(slots[:, j], minlength=SLOTS) for j in range(DIRECTIONS)])
    if total is not None:
        at = np.indices(total.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*at, total.ravel())], ["t", "d", "s", "rows"])


def slot_shares(vectors: DataFrame) -> np.ndarray:
    """Table, direction, slot: the share of vectors(vec_id, v) in it, smoothed. A few hundred numbers."""
    counts = vectors.select("v").mapInArrow(_counted, "t int, d int, s int, rows long").groupBy("t", "d", "s").agg(F.sum("rows").alias("rows")).collect()
    total = np.ones((TABLES, DIRECTIONS, SLOTS))
    for r in counts:
        total[r["t"], r["d"], r["s"]] += r["rows"]
    return total / total.sum(axis=2, keepdims=True)


def _indexed(n: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            if len(x):
                packed, unit = _packed(x), _unit(x)
                for t in range(TABLES):
                    a, shift = _hashing(x.shape[1], t)
                    page = _page_of(_slots(unit @ a, shift), n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(page), b.column(0), packed], ["t", "page", "vec_id", "v"])

    return run


def _probes(shares: np.ndarray, n: int, mass: float):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            for lo in range(0, len(x), 256):
                part, ids, c = x[lo : lo + 256], np.asarray(b.column(0))[lo : lo + 256], np.asarray(b.column(2))[lo : lo + 256]
                packed, unit = _packed(part), _unit(part)
                for t in range(TABLES):
                    a, shift = _hashing(x.shape[1], t)
                    y = unit @ a
                    chance = _chances(y, c, shift)
                    least = _least_gain(_gains(chance, shares[t], c), y, c, shift, mass)
                    pages = [_pages(p, n) for p in chance]
                    at = np.repeat(np.arange(len(part)), [len(p) for p in pages])
                    page = np.concatenate(pages)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(page), pa.array(ids[at]), packed.take(pa.array(at)), pa.array(c[at]), pa.array(least[at])], ["t", "page", "query_id", "q", "c", "least"])

    return run


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of rows of equal number. A pair's value does not depend on the other rows."""
    q, x = _scaled(q), _scaled(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _first(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, queries))
    sorted_ = queries[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def visited(unit_rows: np.ndarray, unit_queries: np.ndarray, c: np.ndarray, least: np.ndarray, t: int, shares: np.ndarray) -> np.ndarray:
    """Query by row: whether the row's bucket is one that the query visits. Gains add up over slots: one matrix product."""
    a, shift = _hashing(unit_rows.shape[1], t)
    hot = np.zeros((len(unit_rows), DIRECTIONS, SLOTS), np.float32)
    np.put_along_axis(hot, _slots(unit_rows @ a, shift)[:, :, None], 1, 2)
    gains = _gains(_chances(unit_queries @ a, c, shift), shares[t], c).astype(np.float32)
    return gains.reshape(len(gains), -1) @ hot.reshape(len(hot), -1).T >= (least - 1e-3)[:, None]


def _ranked(k: int, shares: np.ndarray, dim: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            x, q = _unpacked(left["v"], dim), _unpacked(right["q"], dim)
            ids, queries, t = left["vec_id"].to_numpy(), right["query_id"].to_numpy(), int(left["t"].iloc[0])
            c, least, rows = right["c"].to_numpy(), right["least"].to_numpy(), _unit(x)
            for lo in range(0, len(q), 256):
                part = slice(lo, lo + 256)
                i, j = np.nonzero(visited(rows, _unit(q[part]), c[part], least[part], t, shares))
                score = np.concatenate([np.zeros(0), *(cosines(q[part][i[s : s + 8192]], x[j[s : s + 8192]]) for s in range(0, len(i), 8192))])
                near = np.flatnonzero((1 - score <= REACH * (1 - c[part][i])) | (c[part][i] <= 0))
                i, j, score = i[near], j[near], score[near]
                best = _first(i, ids[j], score, k)
                out.append((queries[part][i[best]], ids[j[best]], score[best]))
        a, b, s = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return run


def _scan(queries: np.ndarray, ids: np.ndarray, k: int):
    """The best k of each batch's rows for a bounded set of queries."""

    def run(batches):
        for b in batches:
            x, pid = _matrix(b.column(1)), np.asarray(b.column(0))
            for i in range(len(queries) if len(x) else 0):
                at = np.flatnonzero(pid != ids[i])
                score = cosines(np.broadcast_to(queries[i], (len(at), x.shape[1])), x[at])
                best = _first(np.zeros(len(at)), pid[at], score, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[i])), pa.array(pid[at][best]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, queries: list, k: int = K) -> DataFrame:
    """Brute force for a bounded list of query rows (vec_id, v): one scan."""
    q = np.array([r["v"] for r in queries], float)
    ids = np.array([r["vec_id"] for r in queries])
    return top(vectors.mapInArrow(_scan(q, ids, k), "query_id long, vec_id long, score double"), k)


FOUND = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = K, mass: float = MASS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each of queries(vec_id, v) among vectors(vec_id, v)."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATING).collect()
    if not asked:
        return vectors.sparkSession.createDataFrame([], FOUND)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    index = staged(vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "index")
    classes = staged(queries.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"), "classes")
    found = _nearest(index, classes, asked, k + 1, mass)  # a class may find its own rows: one more than k
    members = joined(queries.select(F.col("vec_id").alias("own"), "v"), classes.withColumnRenamed("vec_id", "query_id"), "v")
    pairs = members.select("own", "query_id").join(found.drop("rank"), "query_id").where("vec_id <> own")
    return top(pairs.select(F.col("own").alias("query_id"), "vec_id", "score"), k)


def _nearest(index: DataFrame, queries: DataFrame, asked: list, k: int, mass: float) -> DataFrame:
    """The k nearest of distinct queries(vec_id, v), their own rows among them. asked: queries to calibrate by."""
    kth = exact(index, asked, k - 1).groupBy("query_id").agg(F.min("score").alias("s")).agg(F.percentile("s", 0.25).alias("c"), F.min("s").alias("least")).first()
    start, least = (min(NEAR, max(0.0, x or 0.0)) for x in kth)
    shares, dim, rows = slot_shares(index), len(asked[0]["v"]), index.count()
    pages = min(DIRECTIONS, max(0, math.ceil(math.log(max(1, rows) / PAGE, 3))))
    asks = queries.select("vec_id", "v", F.lit(start).alias("c"))
    wider = F.when(F.col("c") > least, F.lit(least)).when(F.col("c") > 0.2, F.col("c") / 2).otherwise(0.0)
    found = None
    while True:
        now = _round(index, asks, k, mass, shares, dim, pages)
        found = staged(now if found is None else top(found.drop("rank").unionByName(now.drop("rank")), k), "found")
        have = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
        few = asks.join(have, "vec_id", "left").where(F.coalesce("n", F.lit(0)) < k).where("c > 0")
        asks = staged(few.select("vec_id", "v", wider.alias("c")), "asks")
        if asks.isEmpty():
            return found


def _round(index: DataFrame, queries: DataFrame, k: int, mass: float, shares: np.ndarray, dim: int, pages: int) -> DataFrame:
    """The best k among the buckets visited by queries(vec_id, v, c), each for its own cosine c."""
    rows = index.select("vec_id", "v").mapInArrow(_indexed(pages), "t int, page long, vec_id long, v binary")
    probes = queries.mapInArrow(_probes(shares, pages, mass), "t int, page long, query_id long, q binary, c double, least double")
    held = rows.groupBy("t", "page").agg(F.count("*").alias("rows"))
    asks = probes.groupBy("t", "page").agg(F.count("*").alias("asks"))
    blocks = staged(held.join(asks, ["t", "page"]).select("t", "page", F.ceil(F.col("rows") / BLOCK).cast("int").alias("x"), F.ceil(F.col("asks") / BLOCK).cast("int").alias("y")), "pages")
    small = blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def placed(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        df = df.join(F.broadcast(blocks) if small else blocks, ["t", "page"])
        df = df.withColumn(own + "b", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return df.withColumn(other + "b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    key = ["t", "page", "xb", "yb"]
    left = placed(rows, "vec_id", "x", "y").select(*key, "vec_id", "v")
    right = placed(probes, "query_id", "y", "x").select(*key, "query_id", "q", "c", "least")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_ranked(k, shares, dim), "query_id long, vec_id long, score double")
    return top(found, k)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = staged(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
