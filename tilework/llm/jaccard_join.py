"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles, exact links, connected groups.

1. Every whole text becomes its set of shingle hashes (64 bits); equal sets form a class, and work goes on with classes.
2. All classes order their shingles alike: shingles whose hash is below a fixed share of the hash range come first, by
   document frequency (counted over all classes) and hash, then the rest by hash. A class with n shingles needs
   a = ceil(t n) of them in any partner, so partners share at least l of its first n - a + l. Shingles in one class only
   fill most prefixes and cost nothing: such texts have no candidates at all.
3. The estimated candidate cost of a class is the sum of the frequencies in its prefix; costly classes lengthen it by
   up to MAX_MATCH - 1 shingles and then require that many more shared ones (the smaller number of the two counts).
4. Frequencies in step 2 are first counted over a share of the hash range (1 - t + ROOM): enough to drop most classes. For the
   classes left, whole sets are fetched once, frequencies are counted again among them over the whole range, and prefixes
   are chosen anew. Classes that share prefix shingles, directly or through others, form families (a distributed search).
5. A family of at most FAMILY classes with FAMILY_SHINGLES shingles is checked in one task: pairs that share as many prefix shingles as required, by
   intersecting whole sets. Larger families (one text may have millions of near copies) stay distributed: star rounds check
   each class against one central pivot and contract what links, then all candidate pairs that are still in different groups
   are checked, whatever their number.

Defined results: null, empty and blank texts have no shingles and link with nothing; null ids are kept (component_id is
the smallest id that is not null in the group, else null); repeated rows are members like any others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilework.llm import kernels as K
from tilework.llm.common import components, joined, staged, table

#: How much larger than 1 - t, a prefix's share of a set, the share of hash values is whose frequencies order prefixes. Without
#: this room most prefixes would run short of counted shingles.
ROOM = 0.05
MAX_MATCH = 4
#: Estimated candidates beyond which a prefix gets one more shingle; each further one at four times as many.
COST = 32
STAR_ROUNDS = 2
#: Classes of a family that one task takes, a matrix of FAMILY ** 2 small numbers, 36 MB, and the shingles of all their sets.
FAMILY = 3000
FAMILY_SHINGLES = 8_000_000
SMALL = "sig long, doc_id long, n long, inside long"
PREFIX = "sig long, token long, at int"
SETS = "sig long, tokens array<long>"


def needed(n, pct: int):
    """The least overlap with a set of n at pct percent."""
    return (pct * n + 99) // 100


def _signature(tokens: np.ndarray) -> int:
    """64 bits of a class; among c classes two share it with a chance of c * c / 2**65."""
    with np.errstate(over="ignore"):
        return int(K.mix(K.mix(tokens + K.U(77)).sum(keepdims=True) + K.U(len(tokens))).view(np.int64)[0])


def counted_share(pct: int) -> float:
    return (100 - pct) / 100 + ROOM


def _top(pct: int) -> np.uint64:
    return K.U(int(counted_share(pct) * 2**64))


def _doc_sets(k: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.column(b, "text")
            got = [(_signature(t) if len(t) else None, len(t), int(np.searchsorted(t, _top(pct)))) for _, t in K.shingle_sets(data, offsets, k)]
            sig, n, inside = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(inside, pa.int64())], ["sig", "doc_id", "n", "inside"])

    return run


def _prefixes(k: int, pct: int):
    """Per text: all shingles of the counted range, and as many others as the longest prefix may need; at: place by hash."""

    def out(sigs, tokens):
        sizes = [len(t) for t in tokens]
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(sigs, np.int64), sizes)), pa.array(np.concatenate(tokens).view(np.int64)), pa.array(at)], ["sig", "token", "at"])

    def run(batches):
        for b in batches:
            data, offsets = K.column(b, "text")
            sigs, tokens, size = [], [], 0
            for _, t in K.shingle_sets(data, offsets, k):
                if not len(t):
                    continue
                use = max(int(np.searchsorted(t, _top(pct))), min(len(t), len(t) - needed(len(t), pct) + MAX_MATCH))
                sigs.append(_signature(t))
                tokens.append(t[:use])
                size += use
                if size > 200_000:
                    yield out(sigs, tokens)
                    sigs, tokens, size = [], [], 0
            if size:
                yield out(sigs, tokens)

    return run


def _sets(k: int):
    def out(sigs, tokens):
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), flat], ["sig", "tokens"])

    def run(batches):
        for b in batches:
            data, offsets = K.column(b, "text")
            sigs, tokens, size = [], [], 0
            for _, t in K.shingle_sets(data, offsets, k):
                if len(t):
                    sigs.append(_signature(t))
                    tokens.append(t)
                    size += len(t)
                    if size > 200_000:
                        yield out(sigs, tokens)
                        sigs, tokens, size = [], [], 0
            if size:
                yield out(sigs, tokens)

    return run


def _linked(pct: int):
    def run(batches):
        for b in batches:
            (ad, ao), (bd, bo) = (_flat(b.column(b.schema.get_field_index(x))) for x in ("a_tokens", "b_tokens"))
            keep = []
            for i in range(b.num_rows):
                x, y = ad[ao[i] : ao[i + 1]], bd[bo[i] : bo[i + 1]]
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * common >= pct * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def jaccard_groups(docs: DataFrame, k: int = 4, pct: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = staged(docs.mapInArrow(_doc_sets(k, pct), SMALL), "sets")
    classes = staged(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("inside").alias("inside")), "classes")
    links = _links(docs, classes, k, pct)
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    group = classes.join(comp, classes.sig == comp.node, "left").select("sig", F.coalesce("comp", "sig").alias("comp"), "least")
    least = group.groupBy("comp").agg(F.min("least").alias("component_id"))
    # the left sides below may hold hot keys, which AQE splits
    by_sig = group.join(least, "comp").select("sig", "component_id")
    out = rows.join(by_sig, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _shared(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """(sig, token, at, df) of the shingles that more than one class has, one row for each class and shingle."""
    tokens = docs.where("text is not null").mapInArrow(_prefixes(k, pct), PREFIX)
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("sig").alias("x"), F.max("sig").alias("y")).where("x < y").select("token", "df")
    return tokens.join(counts, "token").groupBy("sig", "token", "at").agg(F.first("df").alias("df"))


def _useful(shared: DataFrame, classes: DataFrame, pct: int, counted_share: float) -> DataFrame:
    """(sig, n, token, l, share): the shared shingles inside each class's prefix, and the number it requires. In the counted
    range shared ones follow the single ones, by frequency and hash; beyond it a shingle's place is that by hash. classes
    has sig, n, inside (shingles in the counted range). share: of single shingles, in thousandths."""
    top = int(counted_share * 2**64) - 2**63  # shingles are unsigned: with the first bit turned they sort as signed numbers
    counted = F.col("token").bitwiseXOR(F.lit(-(2**63))) < F.lit(top) if counted_share < 1 else F.lit(True)
    shared = shared.withColumn("counted", counted)
    many = shared.groupBy("sig").agg(F.sum(F.col("counted").cast("long")).alias("n_shared"))
    facts = classes.join(many, "sig").select("sig", "n", F.expr("inside - n_shared").alias("n_single"), F.expr(f"n - (({pct} * n + 99) div 100)").alias("slack"))
    place = F.row_number().over(Window.partitionBy("sig", "counted").orderBy("df", "token"))
    ranked = shared.join(facts.where(f"slack + {MAX_MATCH} > n_single"), "sig")
    ranked = ranked.withColumn("rank", F.when(F.col("counted"), F.col("n_single") + place).otherwise(F.col("at") + 1))
    cost = F.sum(F.when(F.col("rank") <= F.col("slack") + 1, F.col("df"))).over(Window.partitionBy("sig"))
    overlap = F.expr(f"({pct} * n + 99) div 100")  # a link needs so many: no more may be asked for
    match = F.least(overlap, F.lit(MAX_MATCH), F.greatest(F.lit(1), 2 + F.floor(F.log(F.col("cost") / COST) / F.log(F.lit(4.0))))).cast("int")
    ranked = ranked.withColumn("cost", cost).where("cost is not null").withColumn("l", match)
    return ranked.where("rank <= slack + l").select("sig", "n", "token", "l", F.expr("1000 * n_single div n").alias("share"))


def _links(docs: DataFrame, classes: DataFrame, k: int, pct: int) -> DataFrame:
    """(a, b): classes that link; enough of them to connect all that are connected."""
    shared = staged(_shared(docs, k, pct), "shared")
    active = staged(_useful(shared, classes, pct, counted_share(pct)).select("sig").distinct().join(classes, "sig").select("sig", "least", "n"), "active")
    # whole sets of the classes that may have partners; an id that other texts share brings theirs too, which the join drops
    ids = active.select(F.col("least").alias("id")).distinct()
    texts = joined(docs.where("text is not null"), ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = staged(joined(texts.mapInArrow(_sets(k), SETS), active.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "active_sets")
    tokens = sets.select("sig", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    again = tokens.join(counts, "token").withColumn("at", F.lit(0))
    useful = staged(_useful(again, active.select("sig", "n", F.col("n").alias("inside")), pct, 1.0), "prefixes")
    first = useful.groupBy("token").agg(F.min("sig").alias("v"))
    family = components(useful.join(first, "token").select(F.col("sig").alias("u"), "v"))
    sized = family.join(active.select(F.col("sig").alias("node"), "n"), "node")
    sizes = sized.groupBy("comp").agg((F.count("*") <= FAMILY).alias("few"), (F.sum("n") <= FAMILY_SHINGLES).alias("short"))
    family = staged(family.join(sizes.select("comp", (F.col("few") & F.col("short")).alias("small")), "comp"), "families")
    lists = useful.groupBy("sig").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.collect_list("token").alias("prefix"))
    members = family.where("small").select(F.col("node").alias("sig"), F.col("comp").alias("family")).join(lists, "sig").join(sets, "sig")
    found = staged(members.groupBy("family").applyInArrow(_family(pct), "a long, b long"), "links")
    large = family.where("not small").select(F.col("node").alias("sig"))
    return found if large.isEmpty() else found.union(_large(useful.join(large, "sig"), sets, pct))


def _large(useful: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Links of families of any size, as step 5 says."""
    found = None
    active = useful.select("sig").distinct()
    labels = active.select("sig", F.col("sig").alias("comp"))
    for turn in range(STAR_ROUNDS + 1):
        part = useful.join(labels, "sig")
        mixed = part.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
        part = part.join(mixed, "token")
        pairs = _stars(part, turn) if turn < STAR_ROUNDS else _pairs(part)
        pairs = pairs.where(f"100 * least(an, bn) >= {pct} * greatest(an, bn)").select("a", "b")
        new = staged(_checked(pairs, sets, pct), f"links{turn}")
        found = new if found is None else found.union(new)
        if turn < STAR_ROUNDS:
            comp = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
            labels = staged(active.join(comp, active.sig == comp.node, "left").select("sig", F.coalesce("comp", "sig").alias("comp")), f"labels{turn}")
    return found


def _incidence(lists: list[np.ndarray]) -> np.ndarray:
    """m x m: how many values each two lists share; lists hold no value twice."""
    m = len(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    _, column, many = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    owner, column = owner[many[column] > 1], column[many[column] > 1]
    out = np.zeros((m, m), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        for lo in range(0, int(column.max()) + 1, 2000):
            at = (column >= lo) & (column < lo + 2000)
            x = np.zeros((m, min(2000, int(column.max()) + 1 - lo)), np.float32)
            x[owner[at], column[at] - lo] = 1
            out += x @ x.T
    return out


def _family(pct: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        m = t.num_rows
        sig, n, need = (np.asarray(t.column(c).chunk(0)) for c in ("sig", "n", "l"))
        (pd_, po), (sd, so) = (_flat(t.column(c).chunk(0)) for c in ("prefix", "tokens"))
        prefixes, sets = ([d[o[i] : o[i + 1]] for i in range(m)] for d, o in ((pd_, po), (sd, so)))
        common = _incidence(prefixes)
        fits = (common >= np.minimum(need[:, None], need[None, :])) & (100 * np.minimum(n[:, None], n[None, :]) >= pct * np.maximum(n[:, None], n[None, :]))
        i, j = np.nonzero(np.triu(fits, 1))
        root = list(range(m))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        both = None
        if len(i) > 20 * m:  # many candidates: all intersections at once
            both = _incidence(sets)
            linked = 100 * both[i, j].astype(np.int64) >= pct * (n[i] + n[j] - both[i, j].astype(np.int64))
            i, j = i[linked], j[linked]
        else:
            order = np.argsort(-common[i, j], kind="stable")
            i, j = i[order], j[order]
        a, b = [], []
        for x, y in zip(i.tolist(), j.tolist()):
            if (p := find(x)) == (q := find(y)):
                continue
            if both is None:
                at = np.searchsorted(sets[y], sets[x])
                same = int((sets[y][np.minimum(at, len(sets[y]) - 1)] == sets[x]).sum())
                if 100 * same < pct * (len(sets[x]) + len(sets[y]) - same):
                    continue
            root[q] = p
            a.append(sig[x])
            b.append(sig[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(col.values).view(K.U), np.asarray(col.offsets)


def _stars(part: DataFrame, turn: int) -> DataFrame:
    """Each class with the one pivot, out of those of its postings, that it shares most postings with. A posting's pivot is at
    first its member with the smallest share of single shingles, then one by a hash that changes with the turn."""
    key = F.struct(F.lit(0).alias("first") if turn else F.col("share").alias("first"), F.xxhash64("sig", F.lit(turn)).alias("h"), "sig", "n", "comp")
    pivot = part.groupBy("token").agg(F.min(key).alias("p"))
    pairs = part.join(pivot, "token").where("comp <> p.comp").groupBy(F.col("sig").alias("a"), F.col("n").alias("an"), F.col("p.sig").alias("b"), F.col("p.n").alias("bn")).agg(F.count("*").alias("c"))
    best = pairs.groupBy("a").agg(F.max(F.struct("c", "b", "an", "bn")).alias("m"))
    return best.select("a", "m.b", "m.an", "m.bn")


def _pairs(part: DataFrame) -> DataFrame:
    """All pairs in different groups that share as many prefix shingles as the lesser of their two requirements."""
    x = part.select("token", F.col("sig").alias("a"), F.col("n").alias("an"), F.col("l").alias("al"), F.col("comp").alias("ac"))
    y = part.select("token", F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("l").alias("bl"), F.col("comp").alias("bc"))
    pairs = x.join(y, "token").where("ac < bc")
    return pairs.groupBy("a", "b", "an", "bn", "al", "bl").agg(F.count("*").alias("c")).where("c >= least(al, bl)")


def _checked(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    a = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("b_tokens"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(_linked(pct), "a long, b long")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), 4, 85)
