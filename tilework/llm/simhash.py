"""SimHash near-duplicates: fingerprints joined on a pyramid of segment popcounts.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes of a text's shingles. Fingerprints link
at DISTANCE or fewer differing bits. The pyramid embeds a fingerprint as the bit counts of its segments: 16 segments of 4 bits,
32 of 2, and in the end the 64 bits themselves. One bit changes one count by one, so the Manhattan distance of counts
is at most the number of differing bits, at every level.

The range join: if p and q differ in at most 4 bits, there is a z that differs in at most REACH = 2 bits from both. Each
fingerprint therefore lies in every cell of the grid (cells are 2 counts wide at the first level, 1 below) in which a z
within REACH of it lies; two that link share the cell of their z on each level, whatever level is asked. A cell of at most
CROWD fingerprints is settled where it is: all its pairs are told apart by the exact number of differing bits, and of what links
only enough links to connect it are given. A cell of more only streams through a task and is left for the next level, entered by those z alone that lie in it. On the last level a cell is one z, so all in it link with each other and the least of them is linked with the rest. So no
cell of over CROWD fingerprints is ever paired off, however many near copies meet there, and none is cut or sampled.

Equal fingerprints are one node from the start. Components come from shared stars (common.components).

Defined results: words are lower-cased A to Z; null, empty and blank texts have fingerprint 0 and link like any other; a text
of fewer than SHINGLE words has its whole sequence as one shingle; very long texts are hashed in pieces; rows of equal id stay
rows; null ids are kept and never name a component unless all its ids are null (then it has none); an empty table gives an
empty result; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import kernels as K
from tilework.llm.common import components, joined, staged, table

SHINGLE = 4
SEED = 42
DISTANCE = 4
REACH = DISTANCE // 2
CROWD = 8192
LEVELS = 3
HASHES = 1 << 15
ROWS = 1 << 15
U = np.uint64
TOUCHED = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)], U)


def _counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text, size: int = K.BLOCK) -> int:
    """The fingerprint of a UTF-8 text (bytes or a view), most significant bit first."""
    counts, n, tail, seen, digest = np.zeros(64, np.int64), 0, [], 0, xxhash.xxh64_intdigest
    for found in K.word_pieces(text, size):
        ws = tail + [w.lower() for w in found]
        seen += len(found)
        line = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ws) else ends
        m = len(ws) - SHINGLE + 1
        for i in range(0, m, HASHES):
            k = min(m, i + HASHES)
            counts += _counts([digest(line[s:e], SEED) for s, e in zip(starts[i:k].tolist(), ends[i + SHINGLE - 1 : k + SHINGLE - 1].tolist())])
        n += max(m, 0)
        tail = ws[-(SHINGLE - 1) :]
    if 0 < seen < SHINGLE:
        counts, n = _counts([digest(b" ".join(tail), SEED)]), 1
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row of docs(doc_id, text)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column(batch, "text")
            fps = [fingerprint(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, U).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def cells(fps: np.ndarray, level: int) -> np.ndarray:
    """The cell of each fingerprint: the packed counts of its segments, two counts to a cell where segments have 4 bits."""
    if level == 2:
        return fps
    two = fps - (fps >> U(1) & U(0x5555555555555555))
    if level == 1:
        return two
    four = (two & U(0x3333333333333333)) + (two >> U(2) & U(0x3333333333333333))
    return four >> U(1) & U(0x3333333333333333)


def _entered(fps: np.ndarray, level: int, inside: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, cell) for each cell of the level that some z within REACH lies in; inside: for each fingerprint
    the cells of the level before from which alone z are taken."""
    zs = fps[:, None] ^ TOUCHED[None, :]
    got = cells(zs, level)
    if inside is None:
        got = np.sort(got, axis=1)
        first = np.ones(got.shape, bool)
        np.not_equal(got[:, 1:], got[:, :-1], out=first[:, 1:])
        return np.nonzero(first)[0], got[first]
    before = cells(zs, level - 1)
    rows = [np.unique(g[np.isin(b, np.asarray(c, np.int64).view(U))]) for g, b, c in zip(got, before, inside)]
    return np.repeat(np.arange(len(fps)), [len(r) for r in rows]), np.concatenate(rows)


def _entries(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy().view(U)
        inside = batch.column(1).to_pylist() if batch.num_columns > 1 else None
        for i in range(0, len(fps), 128):
            row, got = _entered(fps[i : i + 128], level, inside[i : i + 128] if inside else None)
            yield pa.RecordBatch.from_arrays([pa.array(fps[i : i + 128][row].view(np.int64)), pa.array(got.view(np.int64))], ["fp", "cell"])


def links(cell: np.ndarray, fps: np.ndarray, block: int = 512) -> np.ndarray:
    """(m, 2) indices that connect what links inside the cells: all pairs of a cell are tested, a spanning set is given. Rows
    are sorted by cell."""
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(first, len(cell)))
    left = np.arange(len(cell)) - np.repeat(first, size)
    after = np.repeat(size, size) - left - 1  # rows of the cell behind this one
    small = np.repeat(size <= 64, size)
    label, pairs, held = np.arange(len(cell)), [], 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal pairs, held
        pairs.append(np.stack([a, b], 1))
        held += len(a)
        if held > 1 << 20:
            pairs = [_spanning(np.concatenate(pairs), label)]
            held = len(pairs[0])

    at = np.flatnonzero(small & (after > 0))
    for step in range(1, 64):
        at = at[after[at] >= step]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= DISTANCE]
        keep(hit, hit + step)
    for lo, n in zip(first[size > 64].tolist(), size[size > 64].tolist()):
        part = fps[lo : lo + n]
        for i in range(0, n, block):
            a, b = np.nonzero(np.bitwise_count(part[i : i + block, None] ^ part[None, i:]) <= DISTANCE)
            keep(lo + i + a[a < b], lo + i + b[a < b])
    return _spanning(np.concatenate(pairs), label) if pairs else np.zeros((0, 2), np.int64)


def _spanning(pairs: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Each node with the least node that pairs connect it with."""
    label = nodes.copy()
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        for side in (0, 1):
            np.minimum.at(new, pairs[:, side], low)
            np.minimum.at(new, label[pairs[:, side]], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != nodes)
    return np.stack([label[moved], moved], 1)


def _settle(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """Rows (fp, cell) come sorted by cell. Gives (u, v, null) for the links of whole cells, and (fp, null, cell) for rows of
    cells of over crowd rows. What is held is ROWS rows and a cell of crowd rows."""
    def given(fps: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        got = fps[links(cell, fps.view(U))]
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.nulls(len(got), pa.int64())], ["u", "v", "cell"])

    def left(fps: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(cell)], ["u", "v", "cell"])

    def settled(fps: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, len(cell)))
        big = np.repeat(size > crowd, size)
        yield given(fps[~big], cell[~big])
        yield left(fps[big], cell[big])

    fps, cell, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        fps, cell = np.concatenate([fps, batch.column(0).to_numpy()]), np.concatenate([cell, batch.column(1).to_numpy()])
        if crowded is not None:  # the rest of a crowded cell
            cut = int(np.searchsorted(cell, crowded, "right"))
            yield left(fps[:cut], cell[:cut])
            fps, cell = fps[cut:], cell[cut:]
            crowded = crowded if not len(cell) else None
        if len(cell) >= ROWS:
            cut = int(np.searchsorted(cell, cell[-1], "left"))
            yield from settled(fps[:cut], cell[:cut])
            fps, cell = fps[cut:], cell[cut:]
            if len(cell) > crowd:
                crowded = cell[-1]
                yield left(fps, cell)
                fps, cell = fps[:0], cell[:0]
    if len(cell):
        yield from settled(fps, cell)


def near_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v): links among the distinct fingerprints of fps(fp), enough to connect all that link."""
    spark, found = fps.sparkSession, []
    todo = fps
    for level in range(LEVELS):
        # the rows grow here: spread them over tasks by fingerprint first
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        entered = todo.repartition(tasks, "fp").mapInArrow(lambda it, at=level: _entries(it, at), "fp long, cell long")
        if level == LEVELS - 1:
            entered = staged(entered, "cells")
            least = entered.groupBy("cell").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select(F.col("cell").alias("c"), "u")
            found.append(joined(entered, least, F.col("cell") == F.col("c")).where("u <> fp").select("u", F.col("fp").alias("v")).distinct())
            break
        dealt = entered.repartition("cell").sortWithinPartitions("cell")
        done = staged(dealt.mapInArrow(lambda it: _settle(it, crowd), "u long, v long, cell long"), f"links{level}")
        found.append(done.where("cell is null").select("u", "v").distinct())
        rest = done.where("cell is not null")
        if not rest.limit(1).count():
            break
        todo = rest.groupBy(F.col("u").alias("fp")).agg(F.collect_list("cell").alias("inside"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id of each row of docs(doc_id, text)."""
    prints = staged(fingerprints(docs), "fingerprints")
    # a row a fingerprint, with the least id that has it
    known = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = staged(components(near_links(known.select("fp"), crowd)), "parts")
    named = joined(known, parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("part"))
    ids = named.groupBy("part").agg(F.min("least").alias("component_id")).withColumnRenamed("part", "p")
    of = staged(joined(named, ids, F.col("part") == F.col("p")).select(F.col("fp").alias("f"), "component_id"), "groups")
    return joined(prints, of, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
