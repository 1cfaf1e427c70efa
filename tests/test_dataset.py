"""The 2 x 2 mosaic of a manifest, and one variant for each refusal and warning."""

import base64
import io
import zipfile
import zlib

import pytest

from tilework.sources import dataset as D

CHANNELS = {"CH1": [(0, "uint8", "Red", "r"), (1, "uint8", "Green", "g")], "CHF": [(0, "uint16", "488", "b")]}
SOURCES = "path string, file string, h int, w int, pixel_y double, pixel_x double, channels array<struct<page:int,dtype:string,label:string,color:string>>"


def case(name, change=None):
    """Entries, sources and stages of a mosaic, changed for the case."""
    entries, sources, stages = [], {}, {}
    for k, (row, col) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)]):
        for j, tag in enumerate(("CH1", "CHF", "Overlay")):
            file = f"img\\T{row}{col}_{tag}.bz.ome.tif"
            entries.append((3 * k + j, row, col, file))
            if tag != "Overlay":
                sources[file] = [6, 8, 3.0, 2.0, CHANNELS[tag]]
                stages[file] = (1_000_000 - 80_000 * col, 2_000_000 - 60_000 * row, 300_000)
    facts = {"entries": entries, "sources": sources, "stages": stages, "rows": 2, "cols": 2, "how": {}, "content": None}
    if change:
        change(facts)
    content = facts["content"] or D.encode(facts["rows"], facts["cols"], facts["entries"], **facts["how"])
    return name, content, facts


def put(key, at, value):
    def change(f):
        f[key][at] = value

    return change


def rewrite(at, entry):
    return put("entries", at, entry)


def drop(*files):
    def change(f):
        for name in files:
            del f["sources"][name]

    return change


def wide(f):  # eight sources are missing of a grid of 3 x 3
    f["rows"], f["cols"] = 3, 3
    for k, (row, col) in enumerate([(0, 2), (1, 2), (2, 0), (2, 1), (2, 2)]):
        f["entries"] += [(100 + 2 * k, row, col, f"m{k}_CH1.tif"), (101 + 2 * k, row, col, f"m{k}_CHF.tif")]


def double_member(f):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with pytest.warns(UserWarning):
            z.writestr(D.GRID, "<P/>")
            z.writestr(D.GRID, "<P/>")
    f["content"] = out.getvalue()


A, B = "img\\T00_CH1.bz.ome.tif", "img\\T01_CH1.bz.ome.tif"
REFUSED = {
    "unreadable": lambda f: f.update(content=b"no zip"),
    "no_enabled_grid": lambda f: f.update(how={"enabled": "false"}),
    "outside_grid": rewrite(3, (3, 0, 2, B)),
    "no_entries": lambda f: f.update(entries=[]),
    "path_escapes": rewrite(3, (3, 0, 1, "../T01_CH1.tif")),
    "no_tag": rewrite(3, (3, 0, 1, "a_.tif")),
    "tag_twice": rewrite(3, (3, 0, 0, B)),
    "no_sources": lambda f: f["sources"].clear(),
    "missing_files": drop(A),
    "partial_grid": lambda f: f.update(rows=3),
    "sizes_differ": put("sources", B, [6, 9, 3.0, 2.0, CHANNELS["CH1"]]),
    "structure_differs": put("sources", B, [6, 8, 3.0, 2.0, CHANNELS["CH1"][:1]]),
    "pixel_sizes_differ": put("sources", B, [6, 8, 3.5, 2.0, CHANNELS["CH1"]]),
    "tag_missing": lambda f: f["entries"].pop(3),
    "stage_conflict": put("stages", "img\\T01_CHF.bz.ome.tif", (1, 2, 300_000)),
}
WARNED = {
    "count_differs": lambda f: f.update(how={"declared": 7}),
    "labels_differ": put("sources", B, [6, 8, 3.0, 2.0, [(0, "uint8", "Rot", "r"), (1, "uint8", "Green", "g")]]),
    "colors_differ": put("sources", B, [6, 8, 3.0, 2.0, [(0, "uint8", "Red", "x"), (1, "uint8", "Green", "g")]]),
    "stage_z_differs": put("stages", "img\\T01_CHF.bz.ome.tif", (920_000, 2_000_000, 1)),
}


@pytest.fixture(scope="module")
def loaded(spark):
    cases = [case("good"), case("wide", wide), case("twice", double_member)] + [case(n, c) for n, c in {**REFUSED, **WARNED}.items()]
    files = spark.createDataFrame([(n, bytearray(c)) for n, c, _ in cases], "path string, content binary")
    sources = spark.createDataFrame([(n, file, *s) for n, _, f in cases for file, s in f["sources"].items()], SOURCES)
    stages = spark.createDataFrame([(n, file, *s) for n, _, f in cases for file, s in f["stages"].items()], "path string, file string, x long, y long, z long")
    return D.load(D.facts(files).cache(), sources, stages)


def test_each_refusal_and_no_other(loaded):
    got = {r.path: r for r in loaded.refusals.collect()}
    assert {p: r.rule for p, r in got.items()} == {n: n for n in REFUSED} | {"wide": "missing_files", "twice": "unreadable"}
    assert got["wide"].rows == 10 and got["wide"].text.endswith("; and 4 more") and got["wide"].text.startswith("Index100 (0, 2) m0_CH1.tif; Index101")
    assert got["missing_files"].text == f"Index0 (0, 0) {A}" and got["tag_missing"].text == "(0, 1) CH1"
    assert got["tag_twice"].text == "(0, 0) CH1" and got["outside_grid"].rows == 1


def test_warnings_of_what_loads(loaded):
    got = {(r.path, r.rule) for r in loaded.warnings.collect()}
    assert got == {(n, n) for n in WARNED} | {(n, "dtypes_mixed") for n in [*WARNED, "good"]}


def test_tiles_and_channels(loaded):
    tiles = {(r.row, r.col): r for r in loaded.tiles.where("path = 'good'").collect()}
    assert {k: (r.idx, r.x, r.y, r.z) for k, r in tiles.items()} == {(0, 0): (0, 1_000_000, 2_000_000, 300_000), (0, 1): (3, 920_000, 2_000_000, 300_000), (1, 1): (6, 920_000, 1_940_000, 300_000), (1, 0): (9, 1_000_000, 1_940_000, 300_000)}
    assert [(r.tag, r.page, r.label, r.dtype) for r in loaded.channels.where("path = 'good'").orderBy("place").collect()] == [("CH1", 0, "Red", "uint8"), ("CH1", 1, "Green", "uint8"), ("CHF", 0, "488", "uint16")]
    assert loaded.sources.where("path = 'good'").count() == 8
    assert {r.path for r in loaded.tiles.select("path").distinct().collect()} == {"good", *WARNED}


def packed(pages, squeeze=False, broken=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, p in pages:
            z.writestr(f"pages/{k}", "<oops" if k == broken else "<P>" + "".join(f"<StageLocation{c}>{v}</StageLocation{c}>" for c, v in p.items()) + "</P>")
    raw = zlib.compress(out.getvalue()) if squeeze else out.getvalue()
    return f'<o:OME xmlns:o="urn:x"><o:StructuredAnnotations><o:X><o:BinData>{base64.b64encode(raw).decode()}</o:BinData></o:X></o:StructuredAnnotations></o:OME>'


def test_stage_places(spark):
    place = {"X": 5, "Y": -6, "Z": 7}
    rows = [("plain", packed([(0, place)])), ("squeezed", packed([(0, {"X": 1, "Y": 2})], squeeze=True)), ("sorted", packed([(10, {"X": 9, "Y": 9}), (2, place)])), ("conflict", packed([(0, place), (1, {"X": 5, "Y": 8, "Z": 7})])), ("broken", packed([(0, place), (1, place)], broken=0)), ("none", "<OME/>"), ("bad", "<OME"), ("null", None), ("text", packed([(0, {"X": "a", "Y": 1}), (1, place)]))]
    found, warnings = D.stages(D.stage_positions(spark.createDataFrame([("m", f, x) for f, x in rows], "path string, file string, ome_xml string")))
    assert {r.file: (r.x, r.y, r.z) for r in found.collect()} == {"plain": (5, -6, 7), "squeezed": (1, 2, None), "sorted": (5, -6, 7), "conflict": (5, -6, 7), "broken": (5, -6, 7), "text": (5, -6, 7)}
    assert sorted((r.rule, r.detail.split(":")[0]) for r in warnings.collect()) == sorted([("stage", f) for f in ("broken", "none", "bad", "null", "bad", "null")] + [("stage_pages_differ", "sorted"), ("stage_pages_differ", "conflict")])
