"""Binary containers as relations.

A tiled container has a 112-byte little-endian header, row-major tiles of planes, a footer of (offset, size) pairs, a JPEG
thumbnail and an XML description. Offsets count from the end of the header; a tile holds its planes one after the other. Rows in are
(path, content), as Spark's binaryFile source gives them on any store; tiled.py reads parts of large files instead."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: magic, header size, field offsets, and where the description holds what.
MAGIC, HEADER = b"KTL2", 112
FIELDS = {"header_size": ("I", 4), "footer_offset": ("Q", 16), "file_size": ("Q", 24), "image_type": ("I", 32), "tile_size": ("I", 36), "width": ("I", 48), "height": ("I", 52)}
TAGS = {
    "xml_width": ("Image/OriginalImageSize/Width", "int"),
    "xml_height": ("Image/OriginalImageSize/Height", "int"),
    "patch_count": ("Image/PatchNumber", "int"),
    "calibration_nm": ("Image/Calibration", "packed"),
    "lens_name": ("Lens/LensName", "text"),
    "magnification": ("Lens/Magnification", "int"),
    "numerical_aperture": ("Lens/NumericalAperture", "packed"),
    "working_distance_mm": ("Lens/WorkingDistance", "packed"),
    "channel": ("Shooting/Channel", "text"),
    "channel_comment": ("Shooting/ChannelComment", "text"),
    "observation_mode": ("Shooting/Observation", "text"),
    "stage_x": ("Shooting/StageLocationX", "int"),
    "stage_y": ("Shooting/StageLocationY", "int"),
    "stage_z": ("Shooting/StageLocationZ", "int"),
    "region_x_nm": ("Shooting/XyStageRegion/X", "int"),
    "region_y_nm": ("Shooting/XyStageRegion/Y", "int"),
    "pixel_mode": ("Shooting/Parameter/PixelMode", "text"),
    "binning": ("Shooting/Parameter/Binnin", "text"),
    "exposure_numerator": ("Shooting/Parameter/ExposureTime/Numerator", "int"),
    "exposure_denominator": ("Shooting/Parameter/ExposureTime/Denominator", "int"),
}
MOST_TILES = 100_000
#: How far behind the index the thumbnail and the description are looked for.
THUMBNAIL_BYTES, XML_BYTES = 512 * 1024, 1024 * 1024
KINDS = {"int": "long", "packed": "double", "text": "string"}
#: Of every kind: the value of a missing tag.
MISSING = {"int": 0, "packed": 0.0, "text": ""}


class NoContainer(ValueError):
    """The bytes are not those of a container."""


def packed_double(text: str | None) -> float:
    """A double from the decimal text of its 64 bits; 0 if that is no number."""
    try:
        return struct.unpack("<d", struct.pack("<q", int(text or "")))[0]
    except (ValueError, struct.error):
        return 0.0


def packed_text(value: float) -> str:
    return str(struct.unpack("<q", struct.pack("<d", value))[0])


def description_xml(values: dict) -> bytes:
    """The XML description that holds these values of TAGS."""
    root = ET.Element("Data")
    for name, value in values.items():
        path, kind = TAGS[name]
        node = ET.SubElement(root, "SingleFileProperty") if root.find("SingleFileProperty") is None else root.find("SingleFileProperty")
        for part in path.split("/"):
            found = node.find(part)
            node = ET.SubElement(node, part) if found is None else found
        node.text = packed_text(value) if kind == "packed" else str(value)
    return b"<?xml version='1.0' encoding='utf-8'?>" + ET.tostring(root, encoding="utf-8", xml_declaration=False, short_empty_elements=False)


def encode(planes: np.ndarray, tile: int, calibration_nm: float, thumbnail: bytes = b"\xff\xd8\xff\xd9", absent: frozenset[int] = frozenset(), **values) -> bytes:
    """A container of planes (p, h, w) of bytes. absent: tiles from the least of these on have no entry. values: more of TAGS."""
    p, h, w = planes.shape
    body, index, at = [], [], 0
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            part = np.zeros((p, tile, tile), np.uint8)
            cut = planes[:, y : y + tile, x : x + tile]
            part[:, : cut.shape[1], : cut.shape[2]] = cut
            if absent and len(index) >= min(absent):
                continue
            body.append(part.tobytes())
            index.append((at, len(body[-1])))
            at += len(body[-1])
    xml = description_xml({"xml_width": w, "xml_height": h, "patch_count": len(index), "calibration_nm": calibration_nm} | values)
    footer = b"".join(struct.pack("<QQ", *e) for e in index) + thumbnail + xml
    header = bytearray(HEADER)
    header[:4] = MAGIC
    for name, value in (("header_size", HEADER), ("footer_offset", HEADER + at), ("file_size", HEADER + at + len(footer)), ("image_type", p), ("tile_size", tile), ("width", w), ("height", h)):
        struct.pack_into("<" + FIELDS[name][0], header, FIELDS[name][1], value)
    return bytes(header) + b"".join(body) + footer


def header(f: BinaryIO) -> dict:
    """The header's fields; only its bytes are read."""
    f.seek(0)
    raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise NoContainer(f"truncated header: {len(raw)} bytes of {HEADER}")
    if raw[:4] != MAGIC:
        raise NoContainer(f"magic {raw[:4]!r}")
    head = {name: struct.unpack_from("<" + kind, raw, at)[0] for name, (kind, at) in FIELDS.items()}
    if not head["tile_size"]:
        raise NoContainer("tile size 0")
    return head


def tile_index(f: BinaryIO, head: dict) -> list[tuple[int, int]]:
    """(offset, size) of the tiles; ends at the first entry of another size than the first one's."""
    f.seek(head["footer_offset"])
    raw = f.read(max(16, min(head["file_size"] - head["footer_offset"], 16 * MOST_TILES)))
    pairs = np.frombuffer(raw[: len(raw) // 16 * 16], "<u8").reshape(-1, 2)
    if not len(pairs) or not pairs[0, 1]:
        return []
    other = np.flatnonzero(pairs[:, 1] != pairs[0, 1])
    return [(int(o), int(n)) for o, n in pairs[: int(other[0]) if len(other) else len(pairs)]]


def thumbnail(f: BinaryIO, head: dict, tiles: int) -> bytes | None:
    """The first JPEG behind the index."""
    f.seek(head["footer_offset"] + 16 * tiles)
    raw = f.read(THUMBNAIL_BYTES)
    start = raw.find(b"\xff\xd8\xff")
    end = raw.find(b"\xff\xd9", start + 3) if start >= 0 else -1
    return raw[start : end + 2] if end >= 0 else None


def description(f: BinaryIO, head: dict, tiles: int) -> dict:
    """The values of TAGS; missing ones, and all those of a description that can't be read, are MISSING."""
    out = {name: MISSING[kind] for name, (_, kind) in TAGS.items()}
    f.seek(head["footer_offset"] + 16 * tiles)
    raw = f.read(XML_BYTES)
    start = raw.find(b"<?xml")
    end = raw.find(b"</Data>", start) if start >= 0 else -1
    if end < 0:
        return out
    try:
        root = ET.fromstring(raw[start : end + 7].decode("utf-8-sig", "replace"))
    except ET.ParseError:
        return out
    for name, (path, kind) in TAGS.items():
        text = root.findtext("SingleFileProperty/" + path)
        if text:
            try:
                out[name] = packed_double(text) if kind == "packed" else int(text) if kind == "int" else text
            except ValueError:
                pass  # a number that is none counts as missing
    return out


def read_tile(f: BinaryIO, head: dict, entry: tuple[int, int], plane: int, end: int) -> np.ndarray | None:
    """One plane of a tile; None if it lies beyond the end of the file or of the tile."""
    n = head["tile_size"] ** 2
    at = head["header_size"] + entry[0] + plane * n
    if at + n > end or (plane + 1) * n > entry[1]:
        return None
    f.seek(at)
    raw = f.read(n)
    return np.frombuffer(raw, np.uint8).reshape(head["tile_size"], head["tile_size"]) if len(raw) == n else None


HEADERS = "path string, error string, width int, height int, tile_size int, image_type int, n_tiles int, tile_bytes long, thumbnail binary, " + ", ".join(f"{name} {KINDS[kind]}" for name, (_, kind) in TAGS.items())


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def _headers(batches):
    schema = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in HEADERS.split(", ")])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = io.BytesIO(content or b"")
            try:
                head = header(f)
            except NoContainer as e:
                rows.append({"path": path, "error": str(e)})
                continue
            index = tile_index(f, head)
            rows.append({"path": path, **{k: head[k] for k in ("width", "height", "tile_size", "image_type")}, "n_tiles": len(index), "tile_bytes": index[0][1] if index else 0, "thumbnail": thumbnail(f, head, len(index)), **description(f, head, len(index))})
        yield pa.RecordBatch.from_pylist(rows, schema)


def headers(files: DataFrame) -> DataFrame:
    """A row a file: header, description and thumbnail; bad files have an error and are no failure. Header values win over those of
    the description."""
    return files.select("path", "content").mapInArrow(_headers, HEADERS)


def _index(parts):
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            f = io.BytesIO(content or b"")
            try:
                head = header(f)
            except NoContainer:
                continue
            across = -(-head["width"] // head["tile_size"])
            entries = tile_index(f, head)[: across * -(-head["height"] // head["tile_size"])]
            yield pd.DataFrame([(path, k, k // across, k % across, head["tile_size"], o, n) for k, (o, n) in enumerate(entries)], columns=["path", "idx", "ty", "tx", "tile_size", "offset", "size"])


def tiles_of(files: DataFrame) -> DataFrame:
    """(path, idx, ty, tx, tile_size, offset, size): the tiles that lie in the image."""
    return files.select("path", "content").mapInPandas(_index, "path string, idx int, ty int, tx int, tile_size int, offset long, size long")


def tiles_of_regions(index: DataFrame, regions: DataFrame, tile_size: int) -> DataFrame:
    """region, path, ty, tx, offset, size of regions(region, path, y0, x0, y1, x1; ends excluded) of files with this tile size:
    a range join as an explode and an equality join. Absent tiles have no offset."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile_size).cast("int"), F.floor((F.col(b) - 1) / tile_size).cast("int")))
    touched = regions.where("y1 > y0 and x1 > x0").select("region", "path", "x0", "x1", cells("y0", "y1").alias("ty")).select("region", "path", "ty", cells("x0", "x1").alias("tx"))
    return touched.join(index.where(F.col("tile_size") == tile_size).select("path", "ty", "tx", "offset", "size"), ["path", "ty", "tx"], "left").select("region", "path", "ty", "tx", "offset", "size")


def _pixels(parts):
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            f = io.BytesIO(content or b"")
            try:
                head = header(f)
            except NoContainer:
                continue
            size, across, entries = head["tile_size"], -(-head["width"] // head["tile_size"]), tile_index(f, head)
            for k in range(across * -(-head["height"] // size)):
                y, x = np.mgrid[k // across * size : min(head["height"], (k // across + 1) * size), k % across * size : min(head["width"], (k % across + 1) * size)]
                for plane in range(max(1, entries[0][1] // size**2 if entries else 1)):
                    got = read_tile(f, head, entries[k], plane, len(content)) if k < len(entries) else None
                    v = np.zeros(y.shape, np.uint8) if got is None else got[: y.shape[0], : y.shape[1]]
                    yield pd.DataFrame({"path": path, "plane": np.int32(plane), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "v": v.ravel().astype(np.int32)})


def pixels_of(files: DataFrame) -> DataFrame:
    """(path, plane, y, x, v) of all pixels; those of absent tiles are 0. For large files see tiled.region."""
    return files.select("path", "content").mapInPandas(_pixels, "path string, plane int, y int, x int, v int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of the format below a folder; Spark leaves out empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*.[kK][tT][fF]").load(path)
