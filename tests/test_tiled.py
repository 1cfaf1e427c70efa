"""Containers byte by byte, and reads of rectangles that touch only their tiles."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from tilework.sources import containers as C
from tilework.sources import sinks, tiled


def by_hand(image, second, tile, entries=None, xml=b""):
    """Two planes; written after the description of the format alone."""
    h, w = image.shape
    data, index = b"", b""
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            start = len(data)
            for plane in (image, second):
                full = np.zeros((tile, tile), np.uint8)
                cut = plane[y : y + tile, x : x + tile]
                full[: cut.shape[0], : cut.shape[1]] = cut
                data += full.tobytes()
            index += struct.pack("<QQ", start, 2 * tile * tile)
    if entries is not None:
        index = index[: 16 * entries]
    tail = index + b"\xff\xd8\xffthumb\xff\xd9" + xml
    head = b"KTL2" + struct.pack("<II", 112, 112) + bytes(4) + struct.pack("<QQ", 112 + len(data), 112 + len(data) + len(tail)) + struct.pack("<II", 2, tile) + bytes(8) + struct.pack("<II", w, h)
    return head.ljust(112, b"\0") + data + tail


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return rng.integers(1, 255, (50, 70), dtype=np.uint8), rng.integers(1, 255, (50, 70), dtype=np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, images):
    base = tmp_path_factory.mktemp("files")
    (base / "deep").mkdir()
    (base / "a.ktf").write_bytes(by_hand(*images, 16))
    (base / "deep" / "b.KTF").write_bytes(by_hand(images[1], images[0], 16, entries=7))
    (base / "._a.ktf").write_bytes(b"x")
    (base / "bad.ktf").write_bytes(b"KTL2 and no more")
    (base / "empty.ktf").write_bytes(b"")
    return f"file://{base}"


def placed(rows, path_end, shape):
    out = np.full(shape, -1)
    for r in rows:
        if r.path.endswith(path_end):
            out[r.oy, r.ox] = r.v
    return out


def test_rectangles_strides_planes_and_absent_tiles(spark, folder, images):
    rows = tiled.region(spark, folder, 9, 13, 41, 66).collect()
    assert (placed(rows, "a.ktf", (32, 53)) == images[0][9:41, 13:66]).all()
    short = images[1].astype(int)
    for k in range(7, 20):  # behind the last entry
        short[k // 5 * 16 : k // 5 * 16 + 16, k % 5 * 16 : k % 5 * 16 + 16] = 0
    assert (placed(rows, "b.KTF", (32, 53)) == short[9:41, 13:66]).all()
    for stride in (3, 7, 100):
        rows = tiled.region(spark, folder, 9, 13, 41, 66, stride=stride, plane=1).collect()
        want = images[1][9:41:stride, 13:66:stride]
        assert (placed(rows, "a.ktf", want.shape) == want).all()
    assert tiled.region(spark, folder, 60, 0, 90, 20).count() == 0
    rows = tiled.reconstructed(spark, folder, downsample=7, tile_size=16).collect()
    assert (placed(rows, "a.ktf", (13, 18)) == images[0][::4, ::4]).all()


def read(folder, filters=(), **options):
    reader = tiled.PushedReader({"path": folder, **options})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    rows = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
    return reader, rows


def test_only_touched_tiles_are_read(folder):
    boxes = [(0, 0, 1, 1), (15, 15, 17, 17), (16, 16, 32, 48), (0, 0, 50, 70), (49, 69, 900, 900)]
    for y0, x0, y1, x1 in boxes:
        touched = {ty * 5 + tx for ty in range(4) for tx in range(5) if ty * 16 < y1 and ty * 16 + 16 > y0 and tx * 16 < x1 and tx * 16 + 16 > x0}
        for how in ({"y0": y0, "x0": x0, "y1": y1, "x1": x1}, {}):
            filters = [] if how else [GreaterThanOrEqual(("y",), y0), LessThan(("y",), y1), GreaterThan(("x",), x0 - 1), LessThanOrEqual(("x",), x1 - 1), EqualTo(("plane",), 0)]
            reader, _ = read(folder, filters, **how, **({"plane": 0} if how else {}))
            assert sorted(t for p, t in reader.tiles_read if p.endswith("/a.ktf")) == sorted(touched)


def test_parts_cover_each_tile_once(folder):
    for split in (500, 3000, 1 << 30):
        reader, rows = read(folder, split=split)
        assert rows == 2 * 2 * 50 * 70 and len(set(reader.tiles_read)) == 20 + 7 and len(reader.tiles_read) == 2 * 27
    assert len(read(folder, split=3000)[0].partitions()) > 2


def test_pushed_filters_reach_the_reader(spark, folder):
    spark.dataSource.register(tiled.TiledSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("tiles").option("pushdown", "true").load(folder).where("y >= 20 and y < 22 and x = 33 and plane = 1 and v > 0")
        assert got.where("path like '%/a.ktf'").count() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_headers_description_and_thumbnail(spark, folder, images):
    values = {"lens_name": "Plan 4x", "magnification": 400, "numerical_aperture": 0.2, "channel": "Channel4", "stage_x": 10460800, "stage_z": -5, "region_y_nm": 77215200, "pixel_mode": "Monochrome8Bit", "binning": "TwoByTwo", "exposure_numerator": 600}
    content = C.encode(np.stack(images), 32, 2000.0, thumbnail=b"\xff\xd8\xffAB\xff\xd9", **values)
    (row,) = C.headers(spark.createDataFrame([("x", bytearray(content))], "path string, content binary")).collect()
    assert {k: row[k] for k in values} == values
    assert (row.width, row.height, row.tile_size, row.image_type, row.n_tiles, row.tile_bytes, row.calibration_nm, row.patch_count) == (70, 50, 32, 2, 6, 2048, 2000.0, 6)
    assert bytes(row.thumbnail) == b"\xff\xd8\xffAB\xff\xd9" and row.stage_y == 0 and row.channel_comment == "" and row.working_distance_mm == 0.0
    found = {r.path.rsplit("/", 1)[-1]: r for r in C.headers(C.read(spark, folder)).collect()}
    assert set(found) == {"a.ktf", "b.KTF", "bad.ktf"}
    assert found["bad.ktf"].error and found["a.ktf"].error is None and bytes(found["a.ktf"].thumbnail) == b"\xff\xd8\xffthumb\xff\xd9"
    assert found["b.KTF"].n_tiles == 7 and found["a.ktf"].lens_name == ""


def test_index_stops_at_another_size():
    raw = bytearray(by_hand(np.ones((32, 32), np.uint8), np.ones((32, 32), np.uint8), 16))
    at = struct.unpack_from("<Q", raw, 16)[0]
    struct.pack_into("<Q", raw, at + 16 * 2 + 8, 77)
    f = io.BytesIO(bytes(raw))
    assert len(C.tile_index(f, C.header(f))) == 2
    struct.pack_into("<Q", raw, at + 8, 0)
    f = io.BytesIO(bytes(raw))
    assert C.tile_index(f, C.header(f)) == []
    assert C.description(f, C.header(f), 0)["calibration_nm"] == 0.0


def test_written_files_are_whole_and_written_once(spark, tmp_path, images):
    content = C.encode(images[0][None], 16, 1.0)
    files = spark.createDataFrame([(f"c{k}.ktf", bytearray(content)) for k in range(5)], "name string, content binary").repartition(3)
    for _ in range(2):
        assert sinks.write_files(files, f"file://{tmp_path}/out").count() == 5
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"c{k}.ktf" for k in range(5)]
    assert tiled.region(spark, f"file://{tmp_path}/out", 0, 0, 2, 2).count() == 20
