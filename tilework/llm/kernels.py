"""Numpy over the bytes of Arrow string columns: polynomial hashes of words, shingles and byte windows.

All hashes are positional polynomials modulo 2**64 over a table of random odd-free byte values, read from prefix sums:
the hash of bytes i..j is (sum[j] - sum[i]) * B**-i, then mixed. Work goes on in blocks of about BLOCK bytes, so memory
is bounded by a block (and by the longest text's word count), whatever the batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        step = np.full(max(n, BLOCK + 4096), base, U)
        step[0] = U(1)
        got = _powers[int(base)] = np.multiply.accumulate(step)
    return got[:n]


def sums(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Prefix sums, one longer than data."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(INVERSE, len(total))[start] + (end - start).astype(U))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, int64) of a string or binary column; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray):
    """Row ranges (lo, hi) of at most BLOCK bytes, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _long_hash(data: np.ndarray, table: np.ndarray) -> np.uint64:
    total, scale, step = U(0), U(1), U(pow(int(BASE), BLOCK, 1 << 64))
    with np.errstate(over="ignore"):
        for i in range(0, len(data), BLOCK):
            total = total + sums(data[i : i + BLOCK], table)[-1] * scale
            scale = scale * step
        return mix(np.array([total + U(len(data))]))[0]


def _word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; cuts are the offsets where texts begin or end."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    inner = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    inner = inner[solid[inner] & solid[inner + 1]]  # words of two texts that touch
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    if len(inner):
        edge = np.sort(np.concatenate([edge, inner, inner]))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """For each block of rows: (first row, row after the last, hash of each word, its row)."""
    table = LOWER_TABLE if lower else TABLE
    for lo, hi in blocks(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * BLOCK:
            part = data[a:b]
            s, e = _word_spans(part, offsets[lo : hi + 1] - a)
            h = spans(sums(part, table), s, e) if len(s) else np.zeros(0, U)
            yield lo, hi, h, lo + np.searchsorted(offsets[lo : hi + 1] - a, s, "right") - 1
        else:  # one long text, in pieces that end at white space
            parts, i = [], a
            while i < b:
                j = min(b, i + BLOCK)
                while j < b and not SPACE[data[j]]:
                    gap = np.flatnonzero(SPACE[data[j : min(b, j + BLOCK)]])
                    j = j + int(gap[0]) if len(gap) else min(b, j + BLOCK)
                part = data[i:j]
                if len(part) <= 2 * BLOCK:
                    s, e = _word_spans(part, np.zeros(0, np.int64))
                    parts.append(spans(sums(part, table), s, e) if len(s) else np.zeros(0, U))
                else:  # it ends with a word of over a block
                    cut = int(np.flatnonzero(SPACE[part[:BLOCK]])[-1]) + 1 if SPACE[part[:BLOCK]].any() else 0
                    s, e = _word_spans(part[:cut], np.zeros(0, np.int64))
                    if len(s):
                        parts.append(spans(sums(part[:cut], table), s, e))
                    parts.append(np.array([_long_hash(part[cut:], table)], U))
                i = j
            h = np.concatenate(parts) if parts else np.zeros(0, U)
            yield lo, hi, h, np.full(len(h), lo, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Per row: sorted distinct hashes of its k-word shingles; of the whole sequence if it has fewer words; none without words."""
    scale = mix(np.arange(11, 11 + k, dtype=U)) | U(1)
    for lo, hi, h, row in word_hashes(data, offsets):
        first = np.searchsorted(row, np.arange(lo, hi + 1), "left")
        if len(h) >= k:
            s = h[: len(h) - k + 1] * scale[0]
            for i in range(1, k):
                s = s + h[i : len(h) - k + 1 + i] * scale[i]
            s = mix(s)
        for r in range(lo, hi):
            a, b = int(first[r - lo]), int(first[r - lo + 1])
            if b - a >= k:
                got = np.sort(s[a : b - k + 1])
                keep = np.ones(len(got), bool)
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                yield r, got[keep]
            elif b > a:
                yield r, mix((h[a:b] * scale[: b - a]).sum(keepdims=True) + U(b - a))
            else:
                yield r, np.zeros(0, U)


def word_pieces(text, size: int = BLOCK):
    """Lists of the words of a text (bytes or a view of them), in order, from pieces of about size bytes that end at white
    space; only a longer word makes a piece longer."""
    n, i, view = len(text), 0, np.frombuffer(text, np.uint8)
    while i < n:
        j = min(n, i + size)
        while j < n and not SPACE[view[j]]:
            gap = np.flatnonzero(SPACE[view[j : min(n, j + 4096)]])
            j = j + int(gap[0]) if len(gap) else min(n, j + 4096)
        yield bytes(view[i:j]).split()
        i = j
