"""Periodic runs of words: aligned blocks matched across a document by automata over word numbers, grown word by word.

A run is a stretch of words with smallest period q and length of at least max(LEAST, EXPONENT * q) that no word beside it
extends. For a block length B = 2**k, q is compatible if (2B - 1) / 3 <= q < (4B - 1) / 3; each q has one such B, and then
2B - 1 + q <= 4q: a run holds an aligned block and the same words q further on. So at each scale the aligned blocks, as
sequences of word numbers, are the keys of an automaton (pyahocorasick), and the words are searched for all of them in one
pass; an occurrence whose distance from an aligned block of its key is compatible is a seed. The stretch around a seed, grown
to both sides while words at this distance agree, is exact. Of stretches with the same ends the least distance is the
period: if a stretch of 4q words has a smaller period, that divides q, and the stretch grown by it has the same ends.

What is searched: inside a run of a scale's periods each word comes again within the largest compatible distance, before or
after, so only stretches of such words, long enough for the least of the periods, are searched. Two runs of periods p < q share
less than p + q words, else p would be a period of both; so the inside of a run that is found already, from two largest
compatible distances on, is not searched again. This leaves out no run. A seed inside a run whose period divides its distance
would grow to the same ends and is passed over, so a text that is all one run costs little.
Long stretches are searched by windows that overlap by a block and a distance.
Blocks of over GRANULES words are sequences of GRANULES numbers, one for each distinct granule (pairs of shorter granules,
numbered exactly), so keys stay short, and so do an automaton and its fall-backs in texts that repeat themselves.

Words become numbers by a dictionary of the document, so equality is exact. Very long texts: a task holds a text's numbers
and its distinct words, never all its words.

Defined results: a null, empty or blank text has no words and no runs; ties for the longest run go to the smallest start,
then period; null ids and repeated rows stay, other columns are not read; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import kernels as K
from tilework.llm.common import table

LEAST = 6
EXPONENT = 4
WINDOW = 1 << 16
GRANULES = 8


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def numbered(text, size: int = K.BLOCK) -> tuple[np.ndarray, list[bytes]]:
    """Each word of a text as a number, and the words by number."""
    known = _Numbers()
    parts = [np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)) for ws in K.word_pieces(text, size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def _gaps(ids: np.ndarray) -> np.ndarray:
    """How far the nearest other place of each word is."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    step = np.full(n + 1, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    step[1:n][same] = (order[1:] - order[:-1])[same]
    gap = np.empty(n, np.int64)
    gap[order] = np.minimum(step[:-1], step[1:])
    return gap


def _stretches(near: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of true entries of at least `least`."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


class _Names:
    """Equal numbers for equal sequences of g words, g a power of two: pairs of numbers of half the length get new numbers."""

    def __init__(self, ids: np.ndarray):
        self.g, self.names = 1, ids.astype(np.int64)

    def of(self, g: int) -> np.ndarray:
        while self.g < g:
            pair = self.names[: -self.g] * (int(self.names.max()) + 1) + self.names[self.g :]
            self.names, self.g = np.unique(pair, return_inverse=True)[1], 2 * self.g
        return self.names


def _seeds(names: np.ndarray, block: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(start of an aligned block, distance) of the occurrences of blocks at compatible distances. names are those of a
    stretch at granules of max(1, block // GRANULES) words, so a key has at most GRANULES numbers; blocks are aligned inside
    the stretch, from lo up to hi. Words at the same place in a granule are searched together."""
    least, most = (2 * block + 1) // 3, (4 * block - 2) // 3  # the first and last compatible distance
    g = max(1, block // GRANULES)
    starts = range(lo, min(hi, len(names) + g - block), block)
    if not starts:
        return
    keys: dict[tuple, int] = {}
    key_of = [keys.setdefault(tuple(names[s : s + block : g].tolist()), len(keys)) for s in starts]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, k in keys.items():
        automaton.add_word(key, k)
    automaton.make_automaton()
    end = min(len(names), starts[-1] + most + block - g + 1)
    for first in range(g):
        for last, k in automaton.iter(tuple(names[lo + first : end : g].tolist())):
            at = first + last * g - block + g  # from lo
            start = (at - least) // block * block  # the only aligned start that can be compatible
            if start >= 0 and at - start <= most and key_of[start // block] == k:
                yield lo + start, at - start


def runs(ids: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, found, block = len(ids), {}, 2
    if n < LEAST:
        return []
    gap, names = _gaps(ids), _Names(ids)
    # of a run that covers each word, that with the farthest end: its end and period
    far, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    while (least := (2 * block + 1) // 3) * EXPONENT <= n:
        most = (4 * block - 2) // 3
        near = gap <= most
        for i, j in found:
            if j - i > 4 * most:
                near[i + 2 * most : j - 2 * most] = False
        for a, b in _stretches(near, max(LEAST, EXPONENT * least)):
            g = max(1, block // GRANULES)
            part = names.of(g)[a : b - g + 1]
            size = max(window, 8 * block) // block * block
            done: dict[int, int] = {}  # distance: end of the last stretch grown
            for lo in range(0, b - a, size):
                for s, q in _seeds(part, block, lo, lo + size):
                    if s < done.get(q, 0) or (a + s + q + block <= far[a + s] and q % period[a + s] == 0):
                        continue
                    i, j = _grown(ids, a + s, q)
                    done[q] = j - q - a
                    if j - i >= max(LEAST, EXPONENT * q):
                        found[i, j] = min(q, found.get((i, j), q))
                        less = far[i:j] < j
                        far[i:j][less], period[i:j][less] = j, found[i, j]
        block *= 2
    return sorted((i, j - i, q) for (i, j), q in found.items())


def _grown(ids: np.ndarray, s: int, q: int) -> tuple[int, int]:
    """(start, end) of the stretch around s in which words q apart agree."""
    def agree(at: int, side: int) -> int:
        count, step = 0, 64
        while True:
            k = min(step, len(ids) - q - at - count if side > 0 else at - count)
            if k <= 0:
                return count
            lo = at + count if side > 0 else at - count - k
            same = ids[lo : lo + k] == ids[lo + q : lo + q + k]
            if side < 0:
                same = same[::-1]
            if not same.all():
                return count + int(same.argmin())
            count, step = count + k, step * 2

    return s - agree(s, -1), s + agree(s, 1) + q


def collapsed(ids: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those that no run holds after its first period."""
    mark = np.zeros(len(ids) + 1, np.int32)
    for start, length, q in found:
        mark[start + q] += 1
        mark[start + length] -= 1
    return np.cumsum(mark[:-1]) == 0


def joined_sha256(ids: np.ndarray, words: list[bytes]) -> str:
    digest = hashlib.sha256()
    for i in range(0, len(ids), 1 << 16):
        digest.update((b" " if i else b"") + b" ".join([words[k] for k in ids[i : i + (1 << 16)].tolist()]))
    return digest.hexdigest()


@dataclass
class Found:
    runs: list[tuple[int, int, int]]
    kept: np.ndarray  # whether each word stays
    ids: np.ndarray
    words: list[bytes]


def examine(text, change=None) -> Found:
    """Runs of a UTF-8 text (bytes or a view); change may replace the word numbers before."""
    ids, words = numbered(text)
    if change:
        ids = change(ids)
    found = runs(ids)
    return Found(found, collapsed(ids, found), ids, words)


def periodic_tail(doc_id) -> callable:
    """The change of the contract: with h the crc32 of the id, texts of h % 10 = 0 repeat a part of themselves from a word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10

    def change(ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        if h % 10 or not n:
            return ids
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])

    return change


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"


def find_runs(docs: DataFrame, change_of=None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256, n_words,
    n_kept of each row of docs(doc_id, text). change_of(doc_id) may give a change of its word numbers."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column(batch, "text")
            rows = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                got = examine(data[a:b], change_of(doc_id) if change_of else None)
                best = min(got.runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in got.runs).encode()).hexdigest()
                rows.append((len(got.runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, listed, joined_sha256(got.ids[got.kept], got.words), len(got.ids), int(got.kept.sum())))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string() if name.endswith("sha256") else pa.int64()) for c, name in zip(columns, names)]], ["doc_id", *names])

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def collapse(docs: DataFrame) -> DataFrame:
    """docs with the texts' runs cut to one period each: words that stay, joined by one space. Texts without runs are as before."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = K.column(batch, "text")
            out = []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                got = examine(data[a:b])
                out.append(b" ".join([got.words[i] for i in got.ids[got.kept].tolist()]).decode() if got.runs else batch.column(at)[k].as_py())
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(of, docs.schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), periodic_tail)
