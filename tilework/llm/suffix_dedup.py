"""Suffix-array dedup of byte strings: bucket-pointer refinement over sampled suffixes, exact for every byte.

A position p is repeated if the WIDTH bytes from p start anywhere else too. Sorting all suffixes of a corpus would move
many times its bytes, so suffixes are sampled so that equal strings sample alike: among the q-grams of a string of WIDTH
bytes its anchor is the leftmost one of least hash, and all p with the same anchor form one run [pl, pr].

1. Initial buckets: anchors by the hash of their q-gram. A q-gram found at one place only repeats nothing; it is dropped.
2. The context [pl, pr + WIDTH) of an anchor holds all strings of its run. Of each bucket, one anchor of each distinct context
   is taken, and a second one where the context occurs again; what is found for it holds for all that are like it.
3. Every position of these contexts starts in the bucket of its q-gram. A pass sorts on (own bucket, bucket of the position
   STEPS further on); both are buckets of the pass before, so the length that a bucket stands for grows from Q to 64, 128 and
   WIDTH, and a position alone in its bucket takes no part any more, nor does one that points to it. What still shares a bucket
   after the last pass is repeated. The buckets of a task are whole; one of more than BUCKET contexts is named by the same
   pointers, and its last sort is a Spark aggregation.

Exact copies of a whole text need none of this: all their bytes are repeated if there are WIDTH of them at least; one copy
stays as evidence for others. Texts are told apart by 128 bits of their sha256. Buckets are 64-bit hashes: m different
strings collide with a chance of m * m / 2**65.

Defined results: very long texts are worked on in pieces that overlap; null texts are empty and keep nothing (the hash of no bytes); texts shorter than WIDTH lose nothing;
repeated rows are texts of their own, so they repeat each other; null ids are kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm import kernels as K
from tilework.llm.common import joined, staged, table

WIDTH = 200
Q = 32
BUCKET = 4000
#: How far on the later bucket of each pass lies: Q + 32 = 64, 64 + 64 = 128, 128 + 72 = WIDTH.
STEPS = (32, 64, 72)
BITS = 21
ANCHOR = "key binary, a int, pl int, pr int, hq long, he long"


def _qgrams(total: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(total) - q
    return K.mix((total[q:] - total[:-q]) * K.powers(K.INVERSE, n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of x[i : i + w] for each i with w values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, q: int = Q):
    """For the texts in data: row, a, pl, pr (in the text), hq, he of all anchors. data has fewer than 2**BITS bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none, none
    total = K.sums(data)
    grams = _qgrams(total, q)
    low = K.U((1 << BITS) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=K.U), width - q + 1)
    size = np.diff(offsets)
    open_ = np.zeros(len(data) + 1, np.int32)
    rows = np.flatnonzero(size >= width)
    open_[offsets[rows]] += 1
    open_[offsets[rows + 1] - width + 1] -= 1
    p = np.flatnonzero(np.cumsum(open_)[: len(least)])
    if not len(p):
        return none, none, none, none, none, none
    a = (least[p] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    a, pl, pr = a[first], p[first], p[last]
    he = K.mix(K.spans(total, pl, pr + width) + (a - pl).astype(K.U))
    row = np.searchsorted(offsets, pl, "right") - 1
    return row, a - offsets[row], pl - offsets[row], pr - offsets[row], grams[a].view(np.int64), he.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(key, row, got, shift=0):
        _, a, pl, pr, hq, he = got
        return pa.RecordBatch.from_arrays([key.take(pa.array(row)), *(pa.array((x + shift).astype(np.int32)) for x in (a, pl, pr)), pa.array(hq), pa.array(he)], ["key", "a", "pl", "pr", "hq", "he"])

    for b in batches:
        data, offsets = K.column(b, "text")
        key = b.column(b.schema.get_field_index("key"))
        for lo, hi in K.blocks(offsets):
            x, y = int(offsets[lo]), int(offsets[hi])
            if hi == lo + 1 and y - x > K.BLOCK:  # a long text, in pieces that share WIDTH - 1 bytes
                for at in range(x, y - WIDTH + 1, K.BLOCK - WIDTH + 1):
                    end = min(y, at + K.BLOCK)
                    got = anchors(data[at:end], np.array([0, end - at]))
                    if len(got[0]):
                        yield out(key, np.full(len(got[0]), lo), got, at - x)
            else:
                got = anchors(data[x:y], offsets[lo : hi + 1] - x)
                if len(got[0]):
                    yield out(key, lo + got[0], got)


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


FIELDS = ("hq", "he", "a", "pl", "pr", "first")
CONTEXT = "hq long, he long, a int, pl int, pr int, first boolean, key binary, context binary"


def _contexts(batches):
    """The bytes [pl, pr + WIDTH) of the wanted anchors of each text."""
    for b in batches:
        data, offsets = K.column(b, "text")
        want = b.column(b.schema.get_field_index("want"))
        key = b.column(b.schema.get_field_index("key"))
        at = np.asarray(want.offsets)
        for i in range(b.num_rows):
            for lo in range(at[i], at[i + 1], 4096):
                n = min(int(at[i + 1]), lo + 4096) - lo
                fields = [want.values.field(f).slice(lo, n) for f in FIELDS]
                pl, pr = (np.asarray(fields[FIELDS.index(f)]) for f in ("pl", "pr"))
                raw = data[offsets[i] : offsets[i + 1]].tobytes() if n * 8 > (offsets[i + 1] - offsets[i]) / 400 else data[offsets[i] : offsets[i + 1]]
                got = [bytes(raw[s : e + WIDTH]) for s, e in zip(pl.tolist(), pr.tolist())]
                yield pa.RecordBatch.from_arrays([*fields, key.take(pa.array(np.full(n, i))), pa.array(got, pa.binary())], [*FIELDS, "key", "context"])


def _starts(offsets, pl, pr):
    """Owner, and place in data, of every position pl..pr of every context."""
    n = (pr - pl + 1).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, offsets[:-1][owner] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _paired(own: np.ndarray, later: np.ndarray, k: int) -> np.ndarray:
    """The bucket of (own bucket, later bucket) in pass k."""
    return K.mix(own + K.U(0x9E3779B97F4A7C15) * later + K.U(k + 1))


def _shared(bucket: np.ndarray) -> np.ndarray:
    """Whether a bucket has another member."""
    order = np.argsort(bucket)
    x = bucket[order]
    same = np.zeros(len(x) + 1, bool)
    same[1:-1] = x[1:] == x[:-1]
    out = np.zeros(len(x), bool)
    out[order[same[1:] | same[:-1]]] = True
    return out


def refine(data, offsets, pl, pr):
    """Owners and places in data of the positions pl..pr whose WIDTH bytes have an equal one, of whole buckets of contexts."""
    bucket = np.zeros(len(data), K.U)
    bucket[: len(data) - Q + 1] = _qgrams(K.sums(data))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the end of the context
    alive = np.flatnonzero(left >= Q)
    alive = alive[_shared(bucket[alive])]
    length = Q
    for k, step in enumerate(STEPS):
        length += step
        live = np.zeros(len(data), bool)
        live[alive] = True
        alive = alive[left[alive] >= length]
        alive = alive[live[alive + step]]
        bucket[alive] = _paired(bucket[alive], bucket[alive + step], k)
        if k < len(STEPS) - 1:
            alive = alive[_shared(bucket[alive])]
    live = np.zeros(len(data), bool)
    live[alive] = True
    owner, at = _starts(offsets, pl, pr)
    owner, at = owner[live[at]], at[live[at]]
    found = _shared(bucket[at])
    return owner[found], at[found]


def windows(data, offsets, pl, pr):
    """Owners, places in data and last buckets of all positions pl..pr, by the pointers of refine but without its sorts."""
    bucket = np.zeros(len(data) + sum(STEPS), K.U)
    bucket[: len(data) - Q + 1] = _qgrams(K.sums(data))
    for k, step in enumerate(STEPS):
        bucket = _paired(bucket, np.concatenate([bucket[step:], np.zeros(step, K.U)]), k)
    owner, at = _starts(offsets, pl, pr)
    return owner, at, bucket[at]


FOUND = "hq long, he long, s int, e int"


def _block(part: pa.Table):
    part = part.combine_chunks().to_batches()[0]
    f = {n: np.asarray(part.column(part.schema.get_field_index(n))) for n in FIELDS}
    data, offsets = K.column(part, "context")
    return f, data[offsets[0] : offsets[-1]], offsets - offsets[0], part


def _refined(batches):
    """Contexts sorted by bucket in; intervals that are repeated, from the anchor on, out. Holds one bucket more than a block."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table):
        f, data, offsets, part = _block(table)
        key = part.column(part.schema.get_field_index("key"))
        twice = np.concatenate([[False], np.asarray(pc.equal(key.slice(1), key.slice(0, len(key) - 1)).cast("uint8")).astype(bool) & (f["pl"][1:] == f["pl"][:-1]) & (f["hq"][1:] == f["hq"][:-1])])
        if twice.any():  # a row that is there twice is one context
            yield from done(pa.Table.from_batches([part]).filter(pa.array(~twice)))
            return
        owner, at = refine(data, offsets, f["pl"], f["pr"])
        keep = f["first"][owner]
        owner, at = owner[keep], at[keep]
        if len(owner):
            p = at - offsets[:-1][owner] + f["pl"][owner] - f["a"][owner]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (p[1:] != p[:-1] + 1)]))
            last = np.concatenate([first[1:], [len(p)]]) - 1
            who = owner[first]
            yield pa.RecordBatch.from_arrays([pa.array(f["hq"][who]), pa.array(f["he"][who]), pa.array(p[first].astype(np.int32)), pa.array((p[last] + WIDTH).astype(np.int32))], ["hq", "he", "s", "e"])

    size = 0
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            held.append(b.slice(lo, 2000))
            size += held[-1].get_total_buffer_size() * held[-1].num_rows // max(1, b.num_rows)
            if size > K.BLOCK:
                whole = pa.Table.from_batches(held)
                hq = np.asarray(whole.column("hq").combine_chunks())
                cut = int(np.searchsorted(hq, hq[-1]))
                if cut:
                    yield from done(whole.slice(0, cut))
                    held = whole.slice(cut).combine_chunks().to_batches()
                    size = 0
    if held and sum(x.num_rows for x in held):
        yield from done(pa.Table.from_batches(held))


WINDOW = "h long, hq long, he long, p int, first boolean, place long"


def _exploded(batches):
    """For contexts of hot buckets: a row for each position, with its last bucket."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            f, data, offsets, _ = _block(pa.Table.from_batches([b.slice(lo, 2000)]))
            place = np.asarray(b.column(b.schema.get_field_index("place")).slice(lo, 2000))
            owner, at, h = windows(data, offsets, f["pl"], f["pr"])
            p = at - offsets[:-1][owner] + f["pl"][owner]
            where = K.mix(place[owner].view(K.U) + p.astype(K.U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f["hq"][owner]), pa.array(f["he"][owner]), pa.array((p - f["a"][owner]).astype(np.int32)), pa.array(f["first"][owner]), pa.array(where)], ["h", "hq", "he", "p", "first", "place"])


def _cut(batches):
    """Text less its repeated intervals: counts and the hash of what stays."""
    for b in batches:
        data, offsets = K.column(b, "text")
        spans = b.column(b.schema.get_field_index("spans"))
        at, s, e = np.asarray(spans.offsets), np.asarray(spans.values.field("s")), np.asarray(spans.values.field("e"))
        rows = []
        for i in range(b.num_rows):
            order = np.argsort(s[at[i] : at[i + 1]], kind="stable")
            x, y = s[at[i] : at[i + 1]][order].astype(np.int64), np.maximum.accumulate(e[at[i] : at[i + 1]][order].astype(np.int64))
            first = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1]]))
            starts, ends = x[first], y[np.concatenate([first[1:], [len(x)]]) - 1]
            text, kept, last = data[offsets[i] : offsets[i + 1]], hashlib.sha256(), 0
            for j, k in zip(starts.tolist(), ends.tolist()):
                kept.update(text[last:j])
                last = k
            kept.update(text[last:])
            rows.append((int((ends - starts).sum()), len(starts), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("key")), *(pa.array(v) for v in zip(*rows))], ["key", "n_removed", "n_spans", "kept_sha256"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, spans) of docs(doc_id, text): facts has a row for each document with key, n_bytes, sha256, copies;
    spans has key, s, e for texts that occur once: byte intervals that are repeated elsewhere; they may overlap."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    facts = staged(docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "facts")
    classes = staged(facts.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "classes")
    one = docs.where(F.octet_length("text") >= WIDTH)
    found = one.select("key", "text").mapInArrow(_anchor_rows, ANCHOR).withColumn("place", F.xxhash64("key", "a", "pl"))
    again = found.groupBy("hq").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x < y").select("hq")
    # a table of its own, so that a hot q-gram's side of the join may be split
    shared = staged(found.join(staged(again, "again"), "hq").distinct(), "anchors")
    by_context = staged(shared.groupBy("hq", "he").agg(F.min("place").alias("place"), F.max("place").alias("most")), "contexts")
    second = by_context.where("place < most").select("hq", "he", F.col("most").alias("place"), F.lit(False).alias("first"))
    taken = by_context.select("hq", "he", "place", F.lit(True).alias("first")).union(second)
    sizes = staged(taken.groupBy("hq").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    taken = staged(taken.join(sizes, "hq"), "taken")
    want = staged(shared.join(taken, ["hq", "he", "place"]).select("key", *FIELDS, "m"), "want")

    def contexts(part: DataFrame) -> DataFrame:
        keys = part.select("key").distinct().join(classes, "key").select("key", F.col("least").alias("least"))
        texts = joined(one, keys.select(F.col("key").alias("k"), "least"), F.expr("key = k and doc_id <=> least"), "left_semi").select("key", "text")
        lists = part.groupBy("key").agg(F.collect_list(F.struct(*FIELDS)).alias("want"))
        return texts.join(lists.hint("merge"), "key").mapInArrow(_contexts, CONTEXT)

    size = want.agg(F.sum(F.col("pr") - F.col("pl") + WIDTH)).first()[0] or 0
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size >> 25)  # 32 MB of contexts a task
    ordinary = contexts(want.where(f"m <= {BUCKET}")).repartition(n, "hq").sortWithinPartitions("hq", "key", "pl")
    repeated = ordinary.mapInArrow(_refined, FOUND)
    hot = want.where(f"m > {BUCKET}")
    if not hot.isEmpty():
        wide = contexts(hot).distinct().withColumn("place", F.xxhash64("key", "hq")).drop("key").mapInArrow(_exploded, WINDOW)
        twice = staged(wide.groupBy("h").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x < y").select("h"), "twice")
        repeated = repeated.union(wide.where("first").join(twice, "h").select("hq", "he", F.col("p").alias("s"), (F.col("p") + WIDTH).alias("e")))
    # what is found for one anchor holds for all with the same context
    spans = shared.select("hq", "he", "key", "a").join(staged(repeated, "repeated"), ["hq", "he"]).select("key", (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"))
    return facts.join(classes.select("key", "copies"), "key"), staged(spans.join(classes.where("copies = 1").select("key"), "key"), "spans")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    facts, spans = repeated_spans(docs)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    keys = spans.select(F.col("key").alias("k")).distinct()
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    cut = joined(texts, keys, F.expr("key = k"), "left_semi").join(lists.hint("merge"), "key").mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string")
    cut = staged(cut, "cut")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= WIDTH)
    empty = hashlib.sha256().hexdigest()
    return facts.join(cut, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
