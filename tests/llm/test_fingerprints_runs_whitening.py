"""SimHash groups, periodic runs and whitening on awkward rows and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.test_operators import DOCS, LOWER, made_texts, words
from tilework.llm import periodic_runs, simhash, whitening


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts()
    rows = [(k if k % 17 else None, t, "en", "a", None, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[1:4], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_fingerprint(text):
    ws = words((text or "").translate(LOWER))
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps):
    """The least node reachable of each of these distinct fingerprints."""
    nodes = sorted(fps)
    label = {f: f for f in nodes}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_groups(docs, none):
    got = simhash.near_groups(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fp"] % 2**64) for r in got if r["doc_id"] is not None) == sorted((False, r["doc_id"], plain_fingerprint(r["text"])) for r in rows if r["doc_id"] is not None)
    label = grouped({plain_fingerprint(r["text"]) for r in rows})
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            f = label[plain_fingerprint(r["text"])]
            least[f] = min(least.get(f, r["doc_id"]), r["doc_id"])
    assert {(r["fp"] % 2**64, r["component_id"]) for r in got} == {(f, least.get(label[f])) for f in label}
    assert simhash.near_groups(none).count() == 0


def test_fingerprint_in_pieces():
    text = (" ".join(f"w{k % 97}X" for k in range(3000)) + "  ").encode()
    assert simhash.fingerprint(text, 50) == simhash.fingerprint(text) == plain_fingerprint(text.decode())
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("crowd", [1, 6, 2000])
def test_near_links_on_every_level(spark, crowd):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):  # clusters, dense and in chains
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        for step in range(12):
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(centre)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in simhash.near_links(frame, crowd).collect():
        a, b = sorted((root(r["u"] % 2**64), root(r["v"] % 2**64)))
        parent[b] = a
    assert {f: root(f) for f in fps} == grouped(fps)


def plain_runs(ws):
    """Every maximal stretch of every distance; of equal stretches the least distance."""
    found = {}
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def test_runs_against_all_distances():
    rng = random.Random(3)
    for _ in range(600):
        ids = [rng.randrange(rng.choice([1, 2, 3, 9, 40])) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(len(ids) + 1), rng.randint(1, 40)
            for i in range(a, min(len(ids), a + rng.randint(1, 150))):
                ids[i] = ids[a + (i - a) % p]
        assert periodic_runs.runs(np.array(ids, np.int32), rng.choice([1, 32, 1 << 16])) == plain_runs(ids)


def test_runs_of_long_repeats_cost_little():
    one = periodic_runs.examine(b"a b c d e " * 60000)
    assert one.runs == [(0, 300000, 5)] and one.kept.sum() == 5


def test_find_runs(docs, none):
    def wanted(doc_id, text):
        ws, h = words(text), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        found = plain_runs(ws)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))

    got = periodic_runs.find_runs(docs, periodic_runs.periodic_tail).drop("n_words", "n_kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(wanted(r["doc_id"], r["text"])) for r in docs.collect())
    assert periodic_runs.find_runs(none).count() == 0


def test_collapse(spark):
    texts = [None, "", "plain  text stays\n", "x " + "la li " * 9 + "y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in periodic_runs.collapse(frame).orderBy("doc_id").collect()] == [None, "", "plain  text stays\n", "x la li y"]


def plain_whitening(vectors):
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    c = [[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x) / n**3 for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(c))
    away = np.array([[n * v[k] - s[k] for k in range(d)] for v in x], object)
    return e[::-1], u[:, ::-1], away, n


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11)) * np.linspace(0.01, 50, 11)
    rows = [(k, [float(c) for c in v], "clash") for k, v in enumerate(base)]
    odd = [(900, None, ""), (901, [], ""), (902, [1.0] * 10 + [None], ""), (903, [float("nan")] * 11, ""), (904, [float("inf")] + [0.0] * 10, ""), (905, [1.0] * 5, ""), (None, [0.5] * 11, ""), (7, rows[7][1], "")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, whitened string").repartition(5)
    kept = rows + odd[-2:]
    e, u, away, n = plain_whitening([r[1] for r in kept])
    got = whitening.whiten(frame).toPandas()
    assert len(got) == 8 * len(kept) and set(got["n"]) == {n}
    wanted = away.astype(float) @ u[:, :8] / (n * np.sqrt(e[:8]))
    by_id = {r[0]: k for k, r in enumerate(kept)}
    for at, part in got[got["vec_id"].notna()].groupby("component"):
        mine = np.array([wanted[by_id[int(i)], at - 1] for i in part["vec_id"]])
        sign = np.sign(mine @ part["whitened"])
        assert np.abs(mine - sign * part["whitened"]).max() < 1e-7
        assert abs(part["explained"].iloc[0] / (e[at - 1] / e.sum()) - 1) < 1e-9
    squares = [sum(int(c) ** 2 for c in row) for row in away]
    assert all(d == squares[by_id[int(i)]] for i, d in zip(got["vec_id"].dropna(), got["deviation"][got["vec_id"].notna()]))
    assert got["identity_error"].max() < 1e-9


def test_scatter_is_exact_for_any_size(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([1e15, -3e14, 0.001, 7.25e3, -1e-9, 2.0**51]) * rng.random() for _ in range(3)] for _ in range(50)]
    rows = whitening.whole(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4))
    n, sums, c = whitening.scatter(rows)
    y = [[int(np.floor(1024 * e)) for e in v] for v in vectors]
    assert n == 50 and sums == [sum(v[k] for v in y) for k in range(3)]
    assert c == [[n * sum(v[i] * v[j] for v in y) - sums[i] * sums[j] for j in range(3)] for i in range(3)]
    got = whitening.project(rows, whitening.fit(rows)).collect()
    wanted = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for k, v in enumerate(y)}
    assert all(int(r["deviation_exact"]) == wanted[r["vec_id"]] and r["deviation"] == (wanted[r["vec_id"]] if wanted[r["vec_id"]] < 2**63 else None) for r in got)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 3.0]) for k in range(4)], schema)).collect()
    assert {r["explained"] for r in flat if r["component"] == 1} == {1.0} and all(r["whitened"] == 0 for r in flat if r["component"] == 2)
