"""Each operator on awkward rows and against brute force."""

import hashlib
import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tilework.llm import chat_format, common, html_extract, jaccard_join, kernels, line_dedup, mixing, nearest, quality_rules, sentencepieces, suffix_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string"


def made_texts() -> list:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    near = [t.replace(t.split()[0], "Zz", 1) for t in base[:15]] + base[:5] + [base[0] + "\n" + base[1], base[2].upper()]
    odd = [None, "", "   \n\t", "x", "a b c", "a b c", "é ü ▁ 漢字 \u00a0 \n\r\n", "\n".join(["same line here"] * 6), "w " * 3000, "q" * 5000, "# * $ % & | < > " * 5]
    return base + near + odd + ["common boiler line\n" + t for t in base[20:38]]


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k % 17 else None, t, None if k % 9 == 0 else "en", ["a", "b", None, "a"][k % 4], None, "clash", "clash") for k, t in enumerate(texts)]
    rows += rows[1:4]  # repeated rows
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


def test_jaccard_groups(spark, docs, none):
    for k, pct in ((4, 85), (5, 80)):
        rows = docs.select("doc_id", "text").collect()
        sets = []
        for r in rows:
            w = words((r["text"] or "").translate(LOWER))
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= pct * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
        least = {}
        for i, r in enumerate(rows):
            least.setdefault(find(i), []).append(r["doc_id"])
        least = {g: min((x for x in v if x is not None), default=None) for g, v in least.items()}
        expected = sorted(str((r["doc_id"], len(sets[i]), least[find(i)])) for i, r in enumerate(rows))
        for family in (3000, 1):  # 1: the distributed way for large families
            jaccard_join.FAMILY = family
            assert sorted(str(tuple(r)) for r in jaccard_join.jaccard_groups(docs, k, pct).collect()) == expected
    jaccard_join.FAMILY = 3000
    assert jaccard_join.jaccard_groups(none).count() == 0


def test_suffix_dedup(docs, none):
    rows = docs.select("doc_id", "text").collect()
    data = [(r["text"] or "").encode() for r in rows]
    seen = {}
    for x in data:
        for i in range(len(x) - 199):
            seen[x[i : i + 200]] = seen.get(x[i : i + 200], 0) + 1
    expected = []
    for r, x in zip(rows, data):
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        expected.append(str((r["doc_id"], len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest())))
    for bucket in (4000, 1):  # 1: the distributed way for hot buckets
        suffix_dedup.BUCKET = bucket
        assert sorted(str(tuple(r)) for r in suffix_dedup.dedup(docs).collect()) == sorted(expected)
    suffix_dedup.BUCKET = 4000
    assert suffix_dedup.dedup(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and sorted(r["size"] for r in got) == sorted(len(words(r["text"])) for r in docs.collect())
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] or not r["taken"])
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 0.5 * max(r["size"] for r in v) + 1
    again = {(r["doc_id"], r["size"], r["source"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["size"], r["source"], r["taken"]) for r in got}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got if r["size"])
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_every_label_counts(spark, monkeypatch):
    """All documents that are labelled good are trusted, and a label table that is shuffled gives what a broadcast one does."""
    n = 21_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 50) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 50 > 0 as int) AS quality", "0 AS toxic")
    model = quality_rules.Model(docs, labels)
    assert model.trusted == labels.where(quality_rules._good(False)).count() > 15_000
    many = spark.range(45_000)
    assert quality_rules._labelled(many.selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"), quality_rules._good(False), "x").count() > 20_000
    longer = docs.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * 7 + k * k) % 50)))).where("doc_id < 300")
    near = sorted(map(tuple, quality_rules.judge(longer, labels).select("doc_id", "score", "kept").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    assert near == sorted(map(tuple, quality_rules.judge(longer, labels).select("doc_id", "score", "kept").collect())) and len(near) == 300


def test_ratios_stand_in_no_plan(spark):
    docs = spark.createDataFrame([(k, f"a b c d e f g h i j k {k}") for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS toxic")
    out = quality_rules.judge(docs, labels)
    assert out.count() == 40 and len(out._jdf.queryExecution().toString()) < 100_000


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in quality_rules.judge(docs, labels).collect():
        t = r["text"] or ""
        w, at = words(t), {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert tuple(r[n] for n in names) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base), t[:60]
        assert not (r["kept"] and base)
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_cut_and_buckets_follow_the_corpus(spark, monkeypatch):
    """Bad documents that share most words with the good ones; scores and cut against brute force, in both ways of look-up."""
    rng = random.Random(3)
    common, well, badly = ([p + str(k) for k in range(60)] for p in "cwb")
    make = lambda own: " ".join(rng.choice(own if rng.random() < 0.2 else common) for _ in range(120))
    rows = [(k, make(badly if k % 3 == 0 else well)) for k in range(300)] + [(None, "c1 c2"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(240)], "doc_id long, quality int, toxic int")
    ways = []
    for array in (quality_rules.ARRAY, 0):  # 0: ratios as a table
        monkeypatch.setattr(quality_rules, "ARRAY", array)
        monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 50)
        got = {(r["doc_id"], r["text"]): r for r in quality_rules.judge(docs, labels).collect()}
        assert len(got) == len(rows)
        unseen = [r for (k, t), r in got.items() if t and k is not None and k >= 240]  # without labels
        assert sum(r["kept"] == (r["doc_id"] % 3 != 0) for r in unseen) >= 0.95 * len(unseen)
        ways.append({k: (r["score"], r["kept"]) for k, r in got.items()})
    assert all(abs(ways[0][k][0] - ways[1][k][0]) < 1e-9 and ways[0][k][1] == ways[1][k][1] for k in ways[0])
    assert [quality_rules.bucket_count(n) for n in (0, 1 << 22, 1 << 24, 1 << 30, 1 << 36)] == [1 << 16, 1 << 16, 1 << 17, 1 << 20, 1 << 23]

    def xx(*values):  # chained, as xxhash64 over several columns
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
            seed = seed - (1 << 64) if seed >= 1 << 63 else seed
            last, seed = seed, seed % (1 << 64)
        return last

    def grams(t):
        h = [xx(w) for w in words(t)]
        return [x % (1 << 16) for x in h + [xx(a, b) for a, b in zip(h, h[1:])]]

    fold = lambda k: struct.unpack("<q", struct.pack("<q", xx_int(k)))[0] % quality_rules.FOLDS == 0

    def xx_int(k):
        h = xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 7), h)  # the int 7
        return h - (1 << 64) if h >= 1 << 63 else h

    raw, good = Counter(), Counter()
    for k, t in rows:
        raw.update(grams(t))
        if k is not None and k < 240 and k % 3 and not fold(k):
            good.update(grams(t))
    n, m, b = sum(raw.values()), sum(good.values()), 1 << 16
    parts = {x: max(-127, min(127, math.floor(abs(v := 32 * math.log((good[x] + b * raw[x] / n) / (m + b) / (raw[x] / n))) + 0.5) * (1 if v >= 0 else -1))) for x in raw}
    score = {(k, t): sum(parts[x] for x in grams(t)) / len(grams(t)) / 32 if words(t) else 0.0 for k, t in rows}
    assert max(abs(score[k] - v[0]) for k, v in ways[0].items()) < 1e-9
    best = max(sorted({s for s in score.values()}), key=lambda c: sum((s >= c) == bool(k % 3) for (k, t), s in score.items() if k is not None and t and k < 240 and (not k % 3 or fold(k))))
    low, high = min(s for (k, t), s in score.items() if ways[0][k, t][1]), max(s for (k, t), s in score.items() if len(words(t)) >= 10 and not ways[0][k, t][1])
    assert high < low and abs(low - best) < 0.2, (low, high, best)


def test_line_dedup(docs, none):
    rows = docs.collect()
    pages, held = {}, {}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for r in rows:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for x in {strip(x) for x in (r["text"] or "").split("\n")} - {""}:
            held[r["source"], x] = held.get((r["source"], x), 0) + 1
    gone = {k for k, n in held.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    assert gone
    expected = [str((r["doc_id"], None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], strip(x)) not in gone), "clash")) for r in rows]
    got = line_dedup.dedup_lines(docs)
    assert sorted(str((r["doc_id"], r["text"], r["key"])) for r in got.collect()) == sorted(expected)
    assert line_dedup.dedup_lines(none).count() == 0


def library_ids(text: str | None, encode) -> list[int] | None:
    """What the library's own encoder makes of a text; none for literal marks, which it takes for spaces."""
    return None if "\u2581" in (text or "") else encode(text or "")


def test_sentencepieces(docs, none, monkeypatch):
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path()).encode
    encoder = sentencepieces.Encoder(sentencepieces.Vocabulary(sentencepieces.model_path()))
    for giant, chunk, block in ((sentencepieces.GIANT, sentencepieces.CHUNK, sentencepieces.BLOCK), (100, 64, 7)):
        monkeypatch.setattr(sentencepieces, "GIANT", giant)
        monkeypatch.setattr(sentencepieces, "CHUNK", chunk)
        monkeypatch.setattr(sentencepieces, "BLOCK", block)
        got = sentencepieces.encode(docs).collect()
        assert len(got) == docs.count() and got[0]["key"] == "clash"
        by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
        for r in docs.where("doc_id is not null").collect():
            ids = by[r["doc_id"]]["ids"]
            assert encoder.decode(ids) == (r["text"] or "")
            assert by[r["doc_id"]]["decoded_sha256"] == (None if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest())
            assert ids == encoder.ids(r["text"] or "") and library_ids(r["text"], encode) in (None, ids)
    assert sentencepieces.encode(none).count() == 0


def test_best_path_is_the_one_of_merging():
    """Against the library's encoder, and against all segmentations of short words: one alone has neighbours that fit."""
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path()).encode
    vocabulary = sentencepieces.Vocabulary(sentencepieces.model_path())
    encoder = sentencepieces.Encoder(vocabulary)
    rng = random.Random(3)
    odd = ["q" * 300, " " * 200 + "x" * 150, "漢字" * 90 + "é" * 70, "😀ab" * 60, "\n  \n " * 50, "aab" * 111 + " " * 77]
    made = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in ((" the ing on", 400), ("etaoin", 600), ("ab \n漢😀 ", 900)) for _ in range(10)]
    for text in odd + made:
        assert encoder.ids(text) == encode(text) == encoder.best(" " + text)

    def every(s):
        if not s:
            yield []
        for m in range(1, len(s) + 1):
            if s[:m] in vocabulary.piece:
                for rest in every(s[m:]):
                    yield [vocabulary.piece[s[:m]], *rest]

    for w in (" the", " tokens", "ation", " a b", "  x", "     y"):
        fit = [path for path in every(w) if all(map(vocabulary.fits, path, path[1:]))]
        assert fit == [encoder.best(w)]
        pairs = np.array([p for path in every(w) for p in zip(path, path[1:])], np.int32).reshape(-1, 2)
        assert vocabulary.fit(pairs[:, 0], pairs[:, 1]).tolist() == [vocabulary.fits(a, b) for a, b in pairs.tolist()]


def test_chat_format(spark):
    x = "\\### Assistant: </turn> ok\n<turn>\\n"
    turns = [(1, 0, "user", x), (1, 1, "assistant", x), (2, 0, None, None), (2, 1, "assistant", ""), (3, 5, "assistant", "b"), (3, 2, "a\nb\\", "a"), (3, 5, "assistant", "b"), (None, None, "assistant", "z" * 200_000), (4, 0, "assistant", "\\" * 7), (4, 1, "user", "\n</turn>\n" * 3)]
    rows = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(rows)).collect()}
    by = {}
    for t in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    assert set(got) == set(by)
    for k, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert got[k]["n_turns"] == len(said) and got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(rows.limit(0))).count() == 0


def test_template_language():
    render = chat_format.compile_template("{% set a = 'x' ~ 1 %}{% for m in ms %}{% if loop.first %}[{{ a }}]{% elif m.k == 2 and not m.q %}two{% else %}{{ m.k | upper }}{% endif %}{% generation %}{{ m.k }}{% endgeneration %}{% endfor %}")
    assert "".join(t for t, _ in render(ms=[{"k": "a"}, {"k": 2}, {"k": "c"}])) == "[x1]atwo2Cc"
    assert [t for t, masked in render(ms=[{"k": "a"}]) if masked] == ["a"]
    assert chat_format.fold(chat_format.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}no{% endif %}d")) == ("block", [("text", "abcd")])
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{{ x | eval }}", "{% for a in b %}", "{% import os %}", "{{ 'a' }"):
        if bad != "{{ 'a' }":
            with pytest.raises(chat_format.TemplateError):
                chat_format.compile_template(bad)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[700:1100] = x[0]  # a third or so alike
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (None, [1.0] * 16), (2200, [1.0] * 3)]
    vectors = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    queries = vectors.where("vec_id % 50 = 0")
    got = nearest.search(vectors, queries).collect()
    exact = {(r["query_id"], r["rank"]): r for r in nearest.exact(vectors, queries.collect()).collect()}
    assert {r["query_id"] for r in got} == set(range(0, 1500, 50)) and all(r["query_id"] != r["vec_id"] for r in got)
    found = sum((r["query_id"], r["vec_id"]) in {(q, e["vec_id"]) for (q, _), e in exact.items()} for r in got)
    assert found / len(exact) >= 0.9
    for r in got:
        a, b = x[r["query_id"]], x[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    empty = nearest.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert nearest.search(empty, empty).count() == 0


def test_nearest_among_groups_of_copies(spark):
    """60% of the vectors lie in groups of copies: the others' neighbours are far beyond the median radius."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    for g in range(0, 900, 9):
        x[g : g + 9] = x[g] + 1e-4 * rng.normal(size=(9, 32))
    x = x[rng.permutation(1500)]
    vectors = nearest.usable(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).cache()
    queries = vectors.where("vec_id % 15 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in nearest.exact(vectors, queries.collect()).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in nearest.search(vectors, queries).collect()}
    assert len(got) == len(exact) == 500
    assert len(got & exact) / 500 >= 0.9, len(got & exact)


def test_nearest_ties_repeats_and_magnitudes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x[10:40] = x[0]  # equal vectors: the smaller ids win
    x[41], x[42], x[43] = x[40] * 2.0, x[40] * 2.0**-660, x[40] * 2.0**660
    rows = [(k, [float(v) for v in r], "clash") for k, r in enumerate(x)]
    rows += rows[:12]  # repeated rows count once
    vectors = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")).cache()
    assert vectors.count() == 60
    queries = vectors.where("vec_id % 10 = 0")
    got: dict[int, list] = {}
    for r in nearest.search(vectors, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [v for v, _ in got[0]] == [10, 11, 12, 13, 14]
    assert [v for v, _ in got[20]] == [0, 10, 11, 12, 13] and len({s for _, s in got[20]}) == 1
    assert [v for v, _ in got[40][:3]] == [41, 42, 43] and all(abs(s - 1) < 1e-12 for _, s in got[40][:3])
    assert all(len(v) == 5 and all(math.isfinite(s) for _, s in v) for v in got.values())
    few = vectors.where("vec_id < 3")
    assert nearest.search(few, few).count() == 6


def test_nearest_scores_a_small_share(spark):
    """Directions without structure, the hardest case: the buckets visited hold a small share of the rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, c = x[:40], np.full(40, 0.36)
    shares = np.full((nearest.TABLES, nearest.DIRECTIONS, nearest.SLOTS), 1.0)
    for t in range(nearest.TABLES):
        a, shift = nearest._hashing(64, t)
        slots = nearest._slots(x @ a, shift)
        shares[t] += np.stack([np.bincount(slots[:, j], minlength=nearest.SLOTS) for j in range(nearest.DIRECTIONS)])
    shares /= shares.sum(axis=2, keepdims=True)
    seen = np.zeros((40, 6000), bool)
    for t in range(nearest.TABLES):
        a, shift = nearest._hashing(64, t)
        y = q @ a
        least = nearest._least_gain(nearest._gains(nearest._chances(y, c, shift), shares[t], c), y, c, shift, nearest.MASS)
        seen |= nearest.visited(x, q, c, least, t, shares)
    score = q @ x.T
    score[np.arange(40), np.arange(40)] = -2
    best = np.argsort(-score, axis=1)[:, :5]
    assert np.take_along_axis(seen, best, 1).mean() >= 0.9 and seen.mean() < 0.2, (np.take_along_axis(seen, best, 1).mean(), seen.mean())


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://WWW.Example.com/en/1?q=1", "http://b.example.com/en/2#t", "http://example.com/en", "http://k.net/es/3", "http://net/fr/", "http://x.org/de/1", None, "nourl", "http://", "http://h.com?x://y/z", "http://com/", "http://notcom/", "http://a.com:8/é", "http://x.org/de/1"]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(100 + k, f"http://s{k}.{'net/es' if k % 2 else 'com/de'}/{k}", "clash") for k in range(200)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    for k, u, _ in rows:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule[0])
        assert got[k]["verdict"] == (rule[1] or got[k]["verdict"]) and got[k]["verdict"] in ("allow", "block")
    assert got[6]["verdict"] == got[14]["verdict"]
    # held out: the models tell unseen URLs of either kind apart without a rule
    unseen = [(900 + k, f"http://s{901 + k}.{'xnet/es' if k % 2 else 'xcom/de'}/{901 + k}", "") for k in range(100)]
    bare = url_filter.judge(spark.createDataFrame(rows[len(urls) :] + unseen, "page_id long, url string, host string")).where("page_id >= 900").collect()
    assert sum(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in bare) >= 95
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_scores_are_those_of_exact_counts(spark, monkeypatch):
    """Scores of counts in dictionaries, with many more contexts than 65,536; all counts broadcast, and few."""
    from collections import Counter

    rng = random.Random(9)
    urls = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) + (".com/" if k % 2 else ".net/es/") for k in range(6000)] + ["xyz.org/a/b", "q.org/es/", ""]
    df = spark.createDataFrame([(u,) for u in urls], "s string")
    known = spark.createDataFrame([(u, ".com/" in u) for u in urls[:6000]], "s string, good boolean")
    n, m = (Counter(), Counter()), (Counter(), Counter())
    back = lambda u, i, k: ("\2" * 5 + u)[i + 5 - k : i + 5]
    for u in urls[:6000]:
        for i, c in enumerate(u):
            for k in range(6):
                n[".com/" in u][k, back(u, i, k)] += 1
                m[".com/" in u][k, back(u, i, k), c] += 1
    assert sum(k == 5 for k, _ in set(n[0]) | set(n[1])) > 65_536
    scores = []
    for head in (url_filter.HEAD, 1000):
        monkeypatch.setattr(url_filter, "HEAD", head)
        got = {r["s"]: r["score"] for r in url_filter._model(df, known)(df.where("s like '%org%' or s = '' or s like 'a%'"), "s string").collect()}
        assert len(got) > 100 and got[""] == 0
        scores.append(got)
        off = []
        for u, score in got.items():
            logs = [0.0, 0.0]
            for side in (0, 1):
                for i, c in enumerate(u):
                    p = 1 / 256
                    for k in range(6):
                        p = (m[side][k, back(u, i, k), c] + 4 * p) / (n[side][k, back(u, i, k)] + 4)
                    logs[side] += np.log(p)
            off.append(abs(score - (logs[1] - logs[0]) / max(len(u), 1)))
        assert max(off) < 1e-9
    assert all(abs(scores[0][u] - scores[1][u]) < 1e-9 for u in scores[0])


def test_url_verdicts_of_a_dictionary_model(spark):
    """Cut and verdicts, all of them, against counts in dictionaries."""
    from collections import Counter

    rng = random.Random(2)
    rows = [(k, f"http://{''.join(rng.choice('abc') for _ in range(rng.randint(1, 6)))}.{rng.choice(['com', 'net/es', 'net/fr', 'net/xx', 'org/es', 'org'])}/{rng.choice(['a', 'bb', 'es'])}{rng.randint(0, 40)}") for k in range(400)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    strings = {k: got[k]["host"] + got[k]["path"] for k in got}
    folds = {r["s"]: r["f"] for r in spark.createDataFrame([(t,) for t in set(strings.values())], "s string").select("s", F.pmod(F.xxhash64("s", F.lit(3)), F.lit(url_filter.FOLDS)).alias("f")).collect()}
    ruled = [(strings[k], got[k]["verdict"] == "allow") for k in got if got[k]["rule"]]
    n, m = (Counter(), Counter()), (Counter(), Counter())
    back = lambda u, i, k: ("\2" * 5 + u)[i + 5 - k : i + 5]
    for u, good in ruled:
        if folds[u]:
            for i, c in enumerate(u):
                for k in range(6):
                    n[good][k, back(u, i, k)] += 1
                    m[good][k, back(u, i, k), c] += 1

    def score(u):
        logs = [0.0, 0.0]
        for side in (0, 1):
            for i, c in enumerate(u):
                p = 1 / 256
                for k in range(6):
                    p = (m[side][k, back(u, i, k), c] + 4 * p) / (n[side][k, back(u, i, k)] + 4)
                logs[side] += math.log(p)
        return (logs[1] - logs[0]) / max(len(u), 1)

    held = [(score(u), good) for u, good in ruled if not folds[u]]
    good, bad = sum(g for _, g in held), sum(not g for _, g in held)
    cuts = sorted({math.floor(s * url_filter.GRID) for s, _ in held})
    right = lambda c: sum(g and math.floor(s * url_filter.GRID) > c for s, g in held) / good + sum(not g and math.floor(s * url_filter.GRID) <= c for s, g in held) / bad
    at = max(range(len(cuts)), key=lambda i: (right(cuts[i]), -i))
    cut = (cuts[at] + 1 + (cuts[at + 1] if at + 1 < len(cuts) else cuts[at] + 2)) / 2 / url_filter.GRID
    for k, r in got.items():
        assert abs(r["score"] - score(strings[k])) < 1e-9
        assert r["rule"] or r["verdict"] == ("allow" if r["score"] >= cut else "block")
    assert sum(not r["rule"] for r in got.values()) > 50


def test_html_extract(spark):
    w, pair = html_extract.fitted()
    pages = [html_extract.Page(h) for h in html_extract.labelled_pages(150, seed=77)]
    forest = html_extract.Forest(pages)
    p, joint = forest.marginals(w, pair)
    y = np.concatenate([[1 if v is None else v for v in q.label] for q in pages])
    chars = np.concatenate([q.chars for q in pages])
    assert (((p >= 0.5) == y) * chars).sum() / chars.sum() > 0.97  # held-out accuracy by characters
    # messages against brute force over all states of a small tree
    small = html_extract.Forest([html_extract.Page("<div class=nav><p>a b</p><p>c</p></div><article>text<p>d</p></article>")])
    got, _ = small.marginals(w, pair)
    n, unary = len(small.parent), small.x @ w
    weights = np.zeros(n)
    total = 0.0
    for s in range(1 << n):
        z = [(s >> i) & 1 for i in range(n)]
        e = np.exp(sum(unary[i] * z[i] for i in range(n)) + sum(pair[small.kind[i]][z[small.parent[i]], z[i]] for i in range(1, n)))
        total += e
        weights += e * np.array(z)
    assert np.abs(weights / total - got).max() < 1e-9
    html = "<html><head><title>no</title><script>x<y</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title &amp;  one</h1><p>First <b>bold text</b> here.<p>Second&nbsp;one &lt;x&gt;.</article><div class=comments><p>Nice!</p></div><footer>&copy; me</footer>"
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<div>" * 300 + "deep"), (1, "u", html), (6, "u", html.replace("<article>", "<form><select><option>a<option>b</select><button>go</form><article>"))]
    out = html_extract.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in out if r["page_id"] in (1, 6)] == ["Title & one First bold text here. Second one <x>."] * 3
    assert len(out) == 7 and [r["text"] for r in out if r["page_id"] in (2, 3)] == ["", ""] and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = corpus_pipeline.tokenize(spark, docs, str(tmp_path))
    assert kept.count() == docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def extracted(spark, *pages: str) -> list[str]:
    rows = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.extract(rows).orderBy("page_id").collect()]


def test_html_attributes_and_links(spark):
    a = "This is the first paragraph of the story, and it has some words in it."
    b = "The second paragraph goes on, it's longer, and ends here after a while."
    menu = "<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"
    links = "<ul><li><a href='/1'>The first link here</a></li><li><a href='/2'>Another link there</a></li></ul>"
    bare, open_, later, linked = extracted(
        spark,
        f"<body><article><p class=it's>{a}</p><p>{b}</p></article>",
        f"<body><article><p title=\"x>{a}</p><p>{b}</p></article>",
        f"<body><article><p title=\"x>{a}</p><p class=\"y\">{b}</p></article>",
        f"<html><body>{menu}<article><h1>Title of it</h1><p>{a}</p>{links}<p>{b}</p></article></body></html>",
    )
    assert bare == f"{a} {b}" and open_ == f"{a} {b}"
    assert later == b  # the value goes on to the next quote, as in browsers
    assert linked == f"Title of it {a} The first link here Another link there {b}"


def test_html_broken_markup_is_linear(spark):
    pages = ["<a " * 350_000, "<div>" * 20_000 + "</p>" * 20_000, "<div>" * 200_000, "<title>" * 20_000, "<p title='" * 100_000, "<ul><li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<object>" * 20_000 + "</svg>" * 20_000, "</script " * 100_000, "<head>" * 50_000, "<!--" * 200_000, "<" * 500_000]
    w, pair = html_extract.fitted()
    for page in pages:
        start = time.time()
        batch = pa.RecordBatch.from_pylist([{"page_id": 1, "url": "u", "html": page}])
        assert [b.num_rows for b in html_extract._extract(w, pair)([batch])] == [1]
        assert time.time() - start < 20, page[:12]


def test_long_texts_in_pieces(monkeypatch):
    """Blocks of a few hundred bytes: words of over a block, texts of many blocks, anchors across pieces."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    long = " ".join(rng.choice(vocabulary) for _ in range(3000))
    texts = [long, "q" * 5000 + " " + long[:4000] + "w" * 3000, "", None, "a b", long[2000:9000], " " * 4000 + "x" * 2500 + "\n" * 900 + "y", "z" * 1200 + "\t" + "z" * 1199]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "key": pa.array([str(k).encode() for k in range(len(texts))], pa.binary())})
    data, offsets = kernels.column(batch, "text")

    def sets():
        return {r: got.tolist() for r, got in kernels.shingle_sets(data, offsets, 4)}

    def anchors():
        """The positions of each text by anchor: pieces may cut a run, but not change its anchor."""
        out = set()
        for b in suffix_dedup._anchor_rows([batch]):
            out |= {(r["key"], r["a"], p, r["hq"]) for r in b.to_pylist() for p in range(r["pl"], r["pr"] + 1)}
        return out

    whole = sets(), anchors()
    for size in (257, 700, 4096):
        monkeypatch.setattr(kernels, "BLOCK", size)
        assert sets() == whole[0]
        if size > suffix_dedup.WIDTH * 2:
            assert anchors() == whole[1]
    assert sorted(whole[0]) == list(range(len(texts))) and len(whole[1]) == sum(max(0, len((t or "").encode()) - suffix_dedup.WIDTH + 1) for t in texts)


def test_mix_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_COPIES", 3)
    sizes = spark.createDataFrame([(f"s{k:02d}", 3**k) for k in range(12)], "source string, source_size long")
    assert mixing.targets(sizes).count() == 12
    monkeypatch.setattr(mixing, "range", lambda n: range(1), raising=False)
    with pytest.raises(RuntimeError):
        mixing.targets(sizes)


def test_jaccard_asks_for_no_more_than_a_link_needs(spark):
    """Sets of 3 and 4 that share 3 are linked at 70 per cent, however hot their shingles are."""
    rows = [(0, "a b c"), (1, "a b c d")] + [(2 + k, f"a b c x{k} y{k} z{k}") for k in range(600)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 70).collect()}
    assert got[1] == 0 and all(got[k] == k for k in range(2, 602))


def test_near_duplicates_lose_no_text(spark):
    """Ids that several texts share, null ids, empty and repeated texts, against groups by brute force."""
    import corpus_pipeline

    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(8)]
    near = [t.rsplit(" ", 2)[0] for t in base[:4]]
    rows = [(1, base[0]), (2, base[0]), (2, base[5]), (3, near[0]), (4, base[1]), (5, near[1]), (5, near[2]), (6, base[2]), (None, base[3]), (7, near[3]), (7, near[3]), (8, ""), (9, None), (10, "  "), (11, base[6]), (12, base[7])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words((t or "").translate(LOWER)) for _, t in rows)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    stays = {key for i, (key, _) in enumerate(rows) if key is not None and (not sets[i] or least[root(i)] == key)}
    got = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, t)) for i, t in rows if i is None or i in stays)
    assert base[5] in [r["text"] for r in got] and {1, 2, 4} <= {r["doc_id"] for r in got} and 3 not in {r["doc_id"] for r in got}


def test_comments_end_as_html_ends_them(spark):
    words_ = " ".join(f"word{k}" for k in range(60))
    parts = ["<!-- x --!>", "<!-->", "<!--->", "<!-- a <!--!>", "<!--!> gone -->", "<!-- y -->"]
    rows = [(k, f"<html><body><article><p>{words_} one.</p>{c}<p>{words_} two.</p></article></body></html>") for k, c in enumerate(parts)] + [(9, f"<article><p>{words_} one.</p><!-- open")]
    out = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")).collect()}
    assert all(out[k] == f"{words_} one. {words_} two." for k in range(len(parts))) and out[9] == f"{words_} one."
    began = time.time()
    html_extract.Page("<!--!" * 200_000)
    assert time.time() - began < 20
