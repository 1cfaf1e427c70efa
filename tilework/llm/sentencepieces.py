"""SentencePiece encoding and decoding: the segmentation that merging gives, as a best path by a max-plus parallel scan.

The vocabulary and its normalisation (a space before the text, spaces as part of pieces, byte fallback) are those of a
public model file of merges. Merging ends in the one segmentation in which every two neighbours are what merging makes of
the two alone. So a path scores 0 where all its neighbours fit and minus infinity elsewhere, and the best path has the ids
of the file's own encoder. Two pieces fit if, taking their merges back from the last, no merge across the border would have
come first. A character that is in no piece becomes its bytes; so do literal U+2581 characters, which the file would take
for spaces: decoding is an exact inverse for every text.

Short texts are segmented unit by unit (no piece crosses the start of a run of spaces, or a character outside all pieces),
with a table of units already seen. Texts over GIANT characters are cut into chunks of CHUNK dealt out to all tasks; the
result is the same. The states at a border are the pieces that end at it or cross it. Each chunk yields a transfer matrix:
T[i, j] is the best score from the i-th piece at its start to the j-th at its end. Matrices are combined by an associative
max-plus scan, which fixes the boundary states, and each chunk is then backtraced alone. The scan has two levels: products
of BLOCK chunks, then the blocks of a text (at most 512, since a text holds 2 GiB), then each block's own chunks.

Defined results: null and empty texts have no ids; of equal merges the left one is first; repeated rows are encoded alike."""

from __future__ import annotations

import hashlib
import importlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import kernels as K
from tilework.llm.common import staged, table

GIANT = 1 << 16
CHUNK = 1 << 14
BLOCK = 256
SEEN = 400_000
MODEL = "piece_bpe_32k.model"
LOW = np.float32("-inf")
#: The last piece at the start of a text or unit, or after a character told by bytes: all pieces fit it.
FREE = -1
NONE = -2
UNIT = re.compile(r" *[^ \n▁]+|[ ]+|[\n▁]")
#: Positions inside a text that no piece crosses.
CUT = re.compile(r"(?<=[^ ]) |[\n▁]")


def model_path() -> str:
    """Where this machine keeps the public vocabularies; callers may pass another path."""
    return importlib.import_module("public_tokenizers").path(MODEL)


class Vocabulary:
    """Pieces as text (spaces, not marks) with ids and ranks of merging; ids of bytes; bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids = [-1] * 256
        self.bytes: list[bytes] = []
        ranks: dict[str, float] = {}
        ids: dict[str, int] = {}
        for i in range(self.size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.bytes.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                text = text.replace("▁", " ")
                ids[text], ranks[text] = i, -model.get_score(i)
                self.bytes.append(text.encode())
        self._merges(ids, ranks)
        self.longest = max(map(len, self.piece))
        # pieces by a hash of their code points, for many look-ups at once
        rng = np.arange(1, self.longest + 2, dtype=K.U)
        self.factors = K.mix(rng * K.U(0x9E3779B97F4A7C15)) | K.U(1)
        pieces = list(self.piece)
        h = np.array([sum(int(K.mix(np.array([ord(c) + 1], K.U))[0]) * int(self.factors[i + 1]) for i, c in enumerate(p)) % 2**64 for p in pieces], K.U)
        order = np.argsort(h)
        self.hashes = np.append(h[order], K.U(2**64 - 1))
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.hash_ids = np.append(np.array([self.piece[pieces[i]] for i in order], np.int32), np.int32(-1))
        slot = (self.hashes[:-1] >> K.U(44)).astype(np.int64)
        self.slots = np.full(1 << 20, len(pieces), np.int32)
        self.slots[slot] = np.arange(len(pieces), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=1 << 20) > 1

    def _merges(self, ids: dict[str, int], ranks: dict[str, float]) -> None:
        """The pieces that merging can make, each with its two parts, and the rank of every two pieces that make a third."""
        self.rank = np.full(self.size, -1.0)  # single characters are never taken apart
        self.left, self.right = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        self.piece: dict[str, int] = {}
        tied = []
        for text, i in ids.items():
            parts, last = merged(text, ranks)
            if len(parts) > 1:
                continue
            self.piece[text] = i
            if last:
                self.rank[i], self.left[i], self.right[i] = ranks[text], ids[last[0]], ids[last[1]]
                if any(len(c) > 1 and ranks[c] > ranks[text] for c in last):
                    raise ValueError("a piece is ranked before its parts")
                if any(ranks[c] == ranks[text] for c in last):
                    tied.append(text)
        pairs = {}
        for text, i in self.piece.items():
            for m in range(1, len(text)):
                a, b = self.piece.get(text[:m]), self.piece.get(text[m:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = self.rank[i]
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()])
        slot = _pair_slots(self.pair_keys)
        self.pair_slots = np.zeros(1 << 21, np.int32)
        self.pair_slots[slot] = np.arange(len(slot), dtype=np.int32)
        self.pairs_shared = np.bincount(slot, minlength=1 << 21) > 1
        # parts of one rank with their piece (runs of spaces): ranks do not tell the order of merges, so these are merged
        self.tied = np.zeros(self.size, bool)
        self.tied[[self.piece[p] for p in tied]] = True
        tied += [c for c in self.piece if len(c) == 1 and any(c in p for p in tied)]
        self.tied[[self.piece[p] for p in tied]] = True
        self.tied_fit = {self.piece[p] * self.size + self.piece[q] for p in tied for q in tied if merged(p + q, ranks)[0] == [p, q]}
        self.tied_keys = np.array(sorted(self.tied_fit), np.int64)

    def fits(self, a: int, b: int) -> bool:
        """Does merging the text of pieces a and b end in a and b?"""
        if a == FREE or b == FREE:
            return True
        if self.tied[a] and self.tied[b]:
            return a * self.size + b in self.tied_fit
        limit = float("inf")
        while True:
            if self.pairs.get(a * self.size + b, limit) < limit:
                return False
            first, second = self.rank[a], self.rank[b]
            if first < 0 and second < 0:
                return True
            if first > second:  # a's last merge is the later one; a merge across it of equal rank is further right
                limit, a = first, int(self.right[a])
            else:
                limit, b = second + 0.5, int(self.left[b])

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits() for arrays of pieces; a may be FREE."""
        out = np.ones(len(a), bool)
        tied = self.tied[a] & self.tied[b] & (a >= 0)
        if tied.any():
            out[tied] = np.isin(a[tied].astype(np.int64) * self.size + b[tied], self.tied_keys)
        on = np.flatnonzero(~tied & (a >= 0))
        a, b, limit = a[on], b[on], np.full(len(on), np.inf)
        while len(on):
            key = a.astype(np.int64) * self.size + b
            slot = _pair_slots(key)
            at = self.pair_slots[slot]
            rare = self.pairs_shared[slot]
            if rare.any():
                at[rare] = np.minimum(np.searchsorted(self.pair_keys, key[rare]), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            out[on[bad]] = False
            first, second = self.rank[a], self.rank[b]
            go = ~bad & ((first >= 0) | (second >= 0))
            on, a, b, first, second = on[go], a[go], b[go], first[go], second[go]
            later = first > second
            limit = np.where(later, first, second + 0.5)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among those of pieces; the last place stands for none."""
        slot = (h >> K.U(44)).astype(np.int64)
        at = self.slots[slot]
        at[self.hashes[at] != h] = len(self.hashes) - 1
        rare = self.shared[slot]
        if rare.any():
            exact = np.searchsorted(self.hashes, h[rare])
            at[rare] = np.where(self.hashes[np.minimum(exact, len(self.hashes) - 1)] == h[rare], exact, len(self.hashes) - 1)
        return at

    def byte_piece(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]


def _pair_slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(K.U) * K.U(0x9E3779B97F4A7C15)) >> K.U(43)).astype(np.int64)


def merged(text: str, ranks: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging makes of a short text, and the two parts that it put together last."""
    parts, last = list(text), None
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return parts, last
        i = best[1]
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = ["".join(last)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.seen: dict[str, tuple[int, ...]] = {}
        self.fit: dict[int, bool] = {}

    def best(self, s: str, start: int = 0, end: int | None = None, stop: int | None = None, last: int = FREE) -> list[int]:
        """Ids of the best path from start, where the piece last ends, to stop; its last piece begins before end. Merging
        has one result for what stands before a position, so one piece at most ends the path there."""
        end = len(s) if end is None else end
        stop = end if stop is None else stop
        ends: dict[int, tuple[int, int]] = {start: (last, start)}
        get, longest, fits = self.v.piece.get, self.v.longest, self.fits
        for p in range(start, end):
            if p not in ends:
                continue
            before = ends[p][0]
            for m in range(1, min(longest, stop - p) + 1):
                i = get(s[p : p + m])
                if i is not None and fits(before, i):
                    ends[p + m] = i, p
            if self.plain(s[p]):
                ends[p + 1] = FREE, p
        out: list[int] = []
        p = stop
        while p > start:
            i, at = ends[p]
            out += self.v.byte_piece(s[at])[::-1] if i == FREE else [i]
            p = at
        return out[::-1]

    def fits(self, a: int, b: int) -> bool:
        key = a * self.v.size + b
        got = self.fit.get(key)
        if got is None:
            if len(self.fit) > SEEN:
                self.fit.clear()
            got = self.fit[key] = self.v.fits(a, b)
        return got

    def plain(self, c: str) -> bool:
        """Is c told by its bytes? Single characters in no piece of their own are."""
        return c not in self.v.piece

    def unit(self, u: str) -> tuple[int, ...]:
        if len(self.seen) > SEEN:
            self.seen.clear()
        got = self.seen[u] = tuple(self.best(u))
        return got

    def learn(self, units: list[str]) -> None:
        """Segments many short units at once: the same max-plus recursion, each step over all of them."""
        v = self.v
        if len(self.seen) > SEEN:
            self.seen.clear()
        units.sort(key=len)
        for lo in range(0, len(units), 2000):
            part = units[lo : lo + 2000]
            size = np.array([len(u) for u in part])
            width, longest = int(size[-1]), min(v.longest, int(size[-1]))
            codes = np.array(part, dtype=f"<U{width}").view(np.uint32).reshape(len(part), width).astype(np.uint64)
            at = np.arange(len(part))
            mixed = K.mix(codes + K.U(1))
            h = np.zeros((len(part), width), K.U)
            ids = np.full((longest + 1, len(part), width), NONE, np.int32)
            for m in range(1, longest + 1):
                n = width - m + 1
                h[:, :n] += mixed[:, m - 1 :] * v.factors[m]
                ids[m, :, :n] = v.hash_ids[v.find(h[:, :n])]
            last = np.full((width + 1, len(part)), NONE, np.int32)
            last[0] = FREE
            step = np.ones((width + 1, len(part)), np.int32)
            for e in range(1, width + 1):
                top = min(longest, e)
                now = np.stack([ids[m, :, e - m] for m in range(1, top + 1)])
                before = last[e - top : e][::-1]
                m, row = np.nonzero((now >= 0) & (before != NONE))
                fit = v.fit(before[m, row], now[m, row])
                m, row = m[fit], row[fit]
                last[e, row], step[e, row] = now[m, row], m + 1
            known = last[size, at] != NONE
            pieces, place = [], size.copy()
            while (place > 0).any():
                m = np.where(place > 0, step[place, at], 0)
                place = place - m
                pieces.append(np.where(m > 0, ids[m, at, place], -1))
            table = np.stack(pieces[::-1], 1)
            length = (table >= 0).sum(1)
            for i, row in enumerate(table.tolist()):
                self.seen[part[i]] = tuple(row[len(row) - length[i] :]) if known[i] else tuple(self.best(part[i]))

    def learn_all(self, texts) -> None:
        """What these texts' units need, before they are encoded."""
        seen = self.seen
        new = {u for t in texts if t for u in UNIT.findall(" " + t) if u not in seen}
        self.learn([u for u in new if len(u) <= 40 and "\0" not in u])

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.units(" " + text) if text else []

    def units(self, s: str) -> list[int]:
        got, fresh = self._lookup(s)
        if fresh:
            self.learn([u for u in fresh if len(u) <= 40 and "\0" not in u])
            for u in fresh:
                if u not in self.seen:
                    self.unit(u)
            got = [self.seen.get(u) or self.unit(u) for u in UNIT.findall(s)]
        return list(itertools.chain.from_iterable(got))

    def _lookup(self, s: str):
        found = UNIT.findall(s)
        got = list(map(self.seen.get, found))
        return got, ({u for u, g in zip(found, got) if g is None} if None in got else None)

    def decode(self, ids) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that begin before at and end at or after it."""
        spans = ((start, end) for start in range(max(0, at - self.v.longest), at) for end in range(at, min(start + self.v.longest, len(s)) + 1))
        found = [(end, self.v.piece[s[start:end]]) for start, end in spans if s[start:end] in self.v.piece]
        return found + [(at, FREE)] if self.plain(s[at - 1]) else found

    def ways(self, s: str, seeds: list[tuple[int, int]], stop: int) -> dict[int, dict[int, int]]:
        """The pieces that begin before stop and end at or after it, by end and id, with the seeds (as bits) that reach them."""
        get, longest, fits = self.v.piece.get, self.v.longest, self.fits
        alive: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for k, (end, i) in enumerate(seeds):
            alive[end][i] |= 1 << k
        for p in range(min(alive, default=stop), stop):
            here = alive.pop(p, None)
            if here is None:
                continue
            after = [(p + m, i) for m in range(1, min(longest, len(s) - p) + 1) if (i := get(s[p : p + m])) is not None]
            for a, bits in here.items():
                for e, i in after:
                    if fits(a, i):
                        alive[e][i] |= bits
            if self.plain(s[p]):
                for bits in here.values():
                    alive[p + 1][FREE] |= bits
        return alive

    def transfer(self, s: str, lead: int, size: int, last: bool) -> np.ndarray:
        """T[i, j] of the chunk s[lead : lead + size]; s has longest characters before it and longest - 1 after it, where the
        text has them. A text begins and ends in one state."""
        stop = lead + size
        enter = self.states(s, lead) if lead else [(0, FREE)]
        leave = None if last else self.states(s, stop)
        cut = self._cut(s, lead, stop)
        seeds = enter
        if cut:  # all paths meet at the first cut, and any path goes on from the last
            meet = self.ways(s, enter, cut[0])
            first = _bits(meet[cut[0]].values())
            seeds = [(cut[1], FREE)]
        ends = self.ways(s, seeds, stop)
        got = [_bits(ends[stop].values())] if last else [ends[e][i] if e in ends else 0 for e, i in leave]
        if cut:
            got = [first if g else 0 for g in got]
        reached = np.array([[g >> k & 1 for g in got] for k in range(len(enter))], bool).reshape(len(enter), len(got))
        return np.where(reached, np.float32(0), LOW)

    def backtrace(self, s: str, lead: int, size: int, last: bool, enter: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, between these states."""
        stop = lead + size
        at, before = self.states(s, lead)[enter] if lead else (0, FREE)
        end = stop if last else self.states(s, stop)[leave][0]
        cut = self._cut(s, lead, stop)
        if cut:
            return self.best(s, at, cut[0], None, before) + self.units(s[cut[0] : cut[1]]) + self.best(s, cut[1], stop, end)
        return self.best(s, at, stop, end, before)

    def _cut(self, s: str, start: int, end: int):
        """The first and last positions between that no piece crosses."""
        found = CUT.search(s, start + 1, end)
        if found is None:
            return None
        at = end - 1
        while at > found.start() and not CUT.match(s, at):
            at -= 1
        return found.start(), at


def _bits(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Stacked max-plus products."""
    out = np.full((len(a), a.shape[1], b.shape[2]), LOW, np.float32)
    for k in range(a.shape[2]):
        np.maximum(out, a[:, :, k, None] + b[:, k, None, :], out=out)
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products, by pairs: half as many matrices a level."""
    n = len(matrices)
    if n == 1:
        return matrices
    pairs = max_plus(matrices[0 : n - 1 : 2], matrices[1:n:2])
    upto = scan(pairs)
    out = np.empty_like(matrices)
    out[0] = matrices[0]
    out[1::2] = upto[: len(out[1::2])]
    if n > 2:
        even = np.arange(2, n, 2)
        out[even] = max_plus(upto[even // 2 - 1], matrices[even])
    return out


def boundary_states(matrices: np.ndarray, enter: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """(enter, leave) of each chunk on a best path from state enter of the first to state leave of the last."""
    prefix = scan(matrices)[:, enter, :]
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        at = int(np.argmax(prefix[k - 1] + matrices[k][:, leave])) if k else enter
        out.append((at, leave))
        leave = at
    return out[::-1]


def product(matrices: np.ndarray) -> np.ndarray:
    """The product of all, by pairs."""
    while len(matrices) > 1:
        odd = matrices[len(matrices) // 2 * 2 :]
        matrices = np.concatenate([max_plus(matrices[0 : len(matrices) - len(odd) : 2], matrices[1::2]), odd])
    return matrices[0]


def _encoder(shared) -> Encoder:
    return Encoder(shared.value)


def _short(shared, keep: list[str]):
    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                encoder.learn_all(texts)
                got = [encoder.ids(t) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), _lists(got), _digests(encoder, texts, got)], [*keep, "ids", "decoded_sha256"])

    return run


def _lists(got: list[list[int]]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(itertools.chain.from_iterable(got), np.int32, int(ends[-1]))))


def _digests(encoder: Encoder, texts, got) -> pa.Array:
    return pa.array([None if t is None else hashlib.sha256(encoder.decode(g).encode()).hexdigest() for t, g in zip(texts, got)], pa.string())


CHUNKS = "key string, k int, block int, lead int, size int, last boolean, piece string"
MATRICES = "key string, block int, k int, n int, t binary"


def _chunks(longest: int):
    kinds = pa.schema([("key", pa.string()), *((c, pa.int32()) for c in ("k", "block", "lead", "size")), ("last", pa.bool_()), ("piece", pa.string())])

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = " " + text
                for k, at in enumerate(range(0, len(s), CHUNK)):
                    lead = min(at, longest)
                    size = min(CHUNK, len(s) - at)
                    row = {"key": key, "k": k, "block": k // BLOCK, "lead": lead, "size": size, "last": at + size == len(s), "piece": s[at - lead : at + size + longest - 1]}
                    yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return run


def _transfers(shared):
    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            for r in b.to_pylist():
                t = encoder.transfer(r["piece"], r["lead"], r["size"], r["last"])
                whole = [pa.array([r["key"]]), *(pa.array([n], pa.int32()) for n in (r["block"], r["k"], len(t))), pa.array([t.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(whole, ["key", "block", "k", "n", "t"])

    return run


def _matrices(group: pd.DataFrame) -> np.ndarray:
    """The group's matrices in order, filled up to one size."""
    tables = [np.frombuffer(t, np.float32).reshape(n, -1) for n, t in zip(group["n"], group["t"])]
    width = max(max(t.shape) for t in tables)
    out = np.full((len(tables), width, width), LOW, np.float32)
    for k, t in enumerate(tables):
        out[k, : t.shape[0], : t.shape[1]] = t
    return out


def _products(group: pd.DataFrame) -> pd.DataFrame:
    """One matrix a block."""
    group = group.sort_values("k")
    rows, cols = group["n"].iloc[0], len(group["t"].iloc[-1]) // 4 // group["n"].iloc[-1]
    whole = np.ascontiguousarray(product(_matrices(group))[:rows, :cols])
    return pd.DataFrame({"key": group["key"].iloc[:1], "block": group["block"].iloc[:1], "k": group["block"].iloc[:1], "n": np.array([rows], np.int32), "t": [whole.tobytes()]})


def _outer(group: pd.DataFrame) -> pd.DataFrame:
    """States at the borders of a text's blocks."""
    group = group.sort_values("k")
    enter, leave = zip(*boundary_states(_matrices(group)))
    return pd.DataFrame({"key": group["key"], "block": group["block"], "enter": np.array(enter, np.int32), "leave": np.array(leave, np.int32)})


def _inner(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """States at the borders of a block's chunks."""
    left = left.sort_values("k")
    enter, leave = zip(*boundary_states(_matrices(left), int(right["enter"].iloc[0]), int(right["leave"].iloc[0])))
    return pd.DataFrame({"key": left["key"], "k": left["k"], "enter": np.array(enter, np.int32), "leave": np.array(leave, np.int32)})


def _backtraces(shared):
    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            for r in b.to_pylist():
                ids = encoder.backtrace(r["piece"], r["lead"], r["size"], r["last"], r["enter"], r["leave"])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["k"]], pa.int32()), _lists([ids])], ["key", "k", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids (of the vocabulary) and decoded_sha256 (of what the ids decode to); text is left out."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path or model_path())
    shared = spark.sparkContext.broadcast(vocabulary)  # fixed: a vocabulary
    keep = [c for c in docs.columns if c not in ("text", "ids", "decoded_sha256")]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    docs = docs.select(*keep, F.col("text").cast("string").alias("text"))
    giant = F.coalesce(F.char_length("text") > GIANT, F.lit(False))
    short = docs.where(~giant).mapInArrow(_short(shared, keep), f"{fields}, ids array<int>, decoded_sha256 string")
    big = docs.where(giant).withColumn("key", F.sha2("text", 256))
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = big.select("key", "text").mapInArrow(_chunks(vocabulary.longest), CHUNKS)
    chunks = staged(chunks.repartition(n, "key", "k").dropDuplicates(["key", "k"]), "chunks")
    matrices = staged(chunks.mapInArrow(_transfers(shared), MATRICES), "matrices")
    blocks = matrices.groupBy("key", "block").applyInPandas(_products, MATRICES)
    borders = blocks.groupBy("key").applyInPandas(_outer, "key string, block int, enter int, leave int")
    states = matrices.groupBy("key", "block").cogroup(borders.groupBy("key", "block")).applyInPandas(_inner, "key string, k int, enter int, leave int")
    parts = chunks.join(states, ["key", "k"]).mapInArrow(_backtraces(shared), "key string, k int, ids array<int>")
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p")).select("key", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"))
    long = big.drop("text").join(decoded(whole, shared), "key").select(*keep, "ids", "decoded_sha256")
    return short.unionByName(long)


def decoded(ids: DataFrame, shared) -> DataFrame:
    """key, ids with decoded_sha256."""

    def run(batches):
        encoder = _encoder(shared)
        for b in batches:
            got = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _digests(encoder, got, got)], ["key", "ids", "decoded_sha256"])

    return ids.mapInArrow(run, "key string, ids array<int>, decoded_sha256 string")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256")
