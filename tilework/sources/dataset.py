"""Loading a mosaic that a manifest describes: rows of facts, and constraints as relations of refusals.

A manifest is a ZIP of XML; each becomes rows in the task that holds it. All else compares relations: what the manifest names,
what is there, and what inspection found in each source. A rule is a query for the rows that break it; a manifest
with any is refused by the first broken rule, and its rows are counted and shown, MOST_SHOWN at most in the text, none
left out of the count. Many manifests are loaded at once.

sources(path, file, h, w, pixel_y, pixel_x, channels: array<struct<page int, dtype string, label string, color string>>) are
inspected sources that exist, file as the manifest spells it; stages(path, file, x, y, z) where they are known."""

from __future__ import annotations

import base64
import binascii
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SHOWN = 6
# Fixed values of the format: members of a manifest, endings of sources, the tag that is no channel.
GRID, COUNT, INDEX = "GroupFileProperty/ImageJoint/properties.xml", "GroupFileProperty/ImageList/OmeFileList/properties.xml", r"(?:^|/)GroupFileProperty/ImageList/OmeFileList/Index(\d+)/properties\.xml$"
ENDING = r"(?i)((\.bz)?\.ome)?\.tiff?$"
OVERLAY = "overlay"
MANIFEST = pa.schema([("path", pa.string()), ("kind", pa.string()), ("idx", pa.int64()), ("row", pa.int64()), ("col", pa.int64()), ("text", pa.string())])
ROWS = "path string, kind string, idx long, row long, col long, text string"


class Refused(ValueError):
    """The manifest can't be read."""


def encode(rows: int, cols: int, entries: list[tuple[int, int, int, str]], enabled: str = "true", declared: int | None = None) -> bytes:
    """A manifest of entries (index, row, col, file)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(GRID, f"<P><Enabled>{enabled}</Enabled><Row>{rows}</Row><Column>{cols}</Column></P>")
        z.writestr(COUNT, f"<P><Count>{len(entries) if declared is None else declared}</Count></P>")
        for k, row, col, name in entries:
            z.writestr(COUNT.replace("/properties", f"/Index{k}/properties"), f"<P><IndexRow>{row}</IndexRow><IndexColumn>{col}</IndexColumn><FilePath>{name}</FilePath></P>")
    return out.getvalue()


def _text(root: ET.Element, name: str) -> str | None:
    found = next((e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == name), None)
    return None if found is None else (found.text or "").strip() or None


def _number(root: ET.Element, name: str, where: str) -> int:
    try:
        return int(_text(root, name) or "")
    except ValueError:
        raise Refused(f"{where}: {name} is missing or no number") from None


def _facts(content: bytes) -> list[tuple]:
    """(kind, idx, row, col, text) of one manifest: grid, count and entries."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise Refused("no readable ZIP") from None
    names = archive.namelist()
    if len(set(names)) < len(names):
        raise Refused("member names occur twice")

    def read(member: str) -> ET.Element:
        try:
            return ET.fromstring(archive.read(member))
        except (KeyError, OSError, RuntimeError, zipfile.BadZipFile, zlib.error, ET.ParseError):
            raise Refused(f"unreadable XML: {member}") from None

    def only(ending: str) -> ET.Element:
        found = [n for n in names if n.rstrip("/").endswith(ending)]
        if len(found) != 1:
            raise Refused(f"{len(found)} members {ending}, not one")
        return read(found[0])

    grid = only(GRID)
    out = [("grid", None, _number(grid, "Row", "grid"), _number(grid, "Column", "grid"), (_text(grid, "Enabled") or "").lower()), ("count", _number(only(COUNT), "Count", "list"), None, None, None)]
    for name in names:
        if m := re.search(INDEX, name):
            entry, where = read(name), f"Index{int(m[1])}"
            out.append(("entry", int(m[1]), _number(entry, "IndexRow", where), _number(entry, "IndexColumn", where), _text(entry, "FilePath")))
    return out


def facts(files: DataFrame) -> DataFrame:
    """(path, kind, idx, row, col, text) of manifests (path, content): kinds grid, count, entry; error with a text if it can't be read."""
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    got = _facts(content or b"")
                except Refused as why:
                    got = [("error", None, None, None, str(why))]
                rows += [dict(zip(MANIFEST.names, (path, *g))) for g in got]
            yield pa.RecordBatch.from_pylist(rows, MANIFEST)

    return files.select("path", "content").mapInArrow(run, ROWS)


def entries(known: DataFrame) -> DataFrame:
    """(path, idx, row, col, file, tag): the sources that manifests name, but for overlays."""
    name = F.regexp_extract(F.translate("text", "\\", "/"), "[^/]*$", 0)
    tag = F.btrim(F.regexp_extract(F.regexp_replace(name, ENDING, ""), "[^_]*$", 0))
    return known.where("kind = 'entry'").select("path", "idx", "row", "col", F.col("text").alias("file"), tag.alias("tag")).where(F.coalesce(F.lower("tag"), F.lit("")) != OVERLAY)


def stage_positions(sources: DataFrame) -> DataFrame:
    """(path, file, ordinal, x, y, z, warning) of sources(path, file, ome_xml): stage places of pages, numbered in their order, and
    rows with a warning for what can't be read. Places lie in XML members, named by numbers, of ZIPs (plain, or compressed
    once more) in base64 in the annotations."""
    schema = pa.schema([("path", pa.string()), ("file", pa.string()), ("ordinal", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("warning", pa.string())])

    def archive_of(payload: bytes) -> zipfile.ZipFile | None:
        for turn in (lambda p: p, zlib.decompress):
            try:
                return zipfile.ZipFile(io.BytesIO(turn(payload)))
            except (zipfile.BadZipFile, zlib.error):
                pass
        return None

    def places(xml: str):
        try:
            root = ET.fromstring(xml or "")
        except ET.ParseError:
            yield None, "OME XML can't be parsed"
            return
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for data in [d for a in root.iter() if local(a) == "StructuredAnnotations" for d in a.iter() if local(d) == "BinData"]:
            try:
                archive = archive_of(base64.b64decode("".join((data.text or "").split()), validate=True))
            except (ValueError, binascii.Error):
                continue
            members = sorted((n for n in archive.namelist() if n.rsplit("/", 1)[-1].isdigit()), key=lambda n: int(n.rsplit("/", 1)[-1])) if archive else []
            for member in members:
                try:
                    page = ET.fromstring(archive.read(member))
                except (KeyError, OSError, RuntimeError, zipfile.BadZipFile, zlib.error, ET.ParseError):
                    yield None, f"page member can't be read: {member}"
                    continue
                raw = [_text(page, "StageLocation" + c) for c in "XYZ"]
                try:
                    yield (int(raw[0] or ""), int(raw[1] or ""), int(raw[2]) if raw[2] else None), None
                except ValueError:
                    pass

    def run(batches):
        for batch in batches:
            rows = []
            for path, file, xml in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = list(places(xml))
                if not any(p for p, _ in found):
                    found.append((None, "StageLocation is missing"))
                rows += [{"path": path, "file": file, "ordinal": k, "x": p and p[0], "y": p and p[1], "z": p and p[2], "warning": w} for k, (p, w) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return sources.select("path", "file", "ome_xml").mapInArrow(run, "path string, file string, ordinal int, x long, y long, z long, warning string")


def stages(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stages, warnings): the first place of each source; sources whose pages disagree are a warning (path, rule, detail)."""
    good = positions.where("x is not null")
    first = good.groupBy("path", "file").agg(F.min_by(F.struct("x", "y", "z"), "ordinal").alias("s"), F.count_distinct(F.struct("x", "y", F.coalesce("z", F.lit(-(2**62))))).alias("n"))
    told = positions.where("warning is not null").select("path", F.lit("stage").alias("rule"), F.concat_ws(": ", "file", "warning").alias("detail"))
    differ = first.where("n > 1").select("path", F.lit("stage_pages_differ").alias("rule"), F.col("file").alias("detail"))
    return first.select("path", "file", "s.*"), told.union(differ)


@dataclass
class Loaded:
    """refusals(path, rule, rows, text): the first broken rule of each refused manifest. warnings(path, rule, detail). Of the others:
    tiles(path, row, col, idx, x, y, z), sources(path, row, col, tag, file), channels(path, tag, page, dtype, label, color, place)."""

    refusals: DataFrame
    warnings: DataFrame
    tiles: DataFrame
    sources: DataFrame
    channels: DataFrame


def load(known: DataFrame, sources: DataFrame, placed: DataFrame) -> Loaded:
    """Checks the facts of manifests against inspected sources and their stages (first places)."""
    grid = known.where("kind = 'grid'").select("path", F.col("row").alias("rows"), F.col("col").alias("cols"), F.col("text").alias("enabled"))
    raw = known.where("kind = 'entry'")
    named = entries(known)
    there = named.join(sources, ["path", "file"])
    slot = F.format_string("(%d, %d)", "row", "col")
    numbered = lambda f: F.format_string("Index%d (%d, %d) %s", "idx", "row", "col", f)

    def twice(df: DataFrame, keys: list[str], detail) -> DataFrame:
        found = df.groupBy("path", *keys).agg(F.count("*").alias("n"), F.min("idx").alias("least")).where("n > 1")
        return found.select("path", F.col("least").alias("idx"), detail.alias("detail"))

    def unlike(value, keys: list[str]) -> DataFrame:
        """Sources whose value differs from that of the first source (by place, then index) of the same keys."""
        first = F.first(value).over(Window.partitionBy("path", *keys).orderBy("row", "col", "idx"))
        return there.withColumn("own", value).withColumn("first", first).where(~F.col("own").eqNullSafe(F.col("first"))).withColumn("detail", F.col("file"))

    shape = F.transform("channels", lambda c: F.struct(c["page"], c["dtype"]))
    tags = named.select("path", "tag").distinct()
    lacking = there.select("path", "row", "col").distinct().join(tags, "path").join(there.select("path", "row", "col", "tag"), ["path", "row", "col", "tag"], "left_anti")
    at = there.join(placed, ["path", "file"])
    first = Window.partitionBy("path", "row", "col").orderBy("idx")
    seen = at.withColumn("fx", F.first("x").over(first)).withColumn("fy", F.first("y").over(first)).withColumn("fz", F.first("z").over(first))
    slots = there.groupBy("path").agg(F.count_distinct("row", "col").alias("n"))
    sizes = there.groupBy("path").agg(F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.array("pixel_y"))))).alias("py"), F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.array("pixel_x"))))).alias("px"))
    # in the order in which they are tried
    rules = [
        ("unreadable", known.where("kind = 'error'").withColumn("detail", F.col("text"))),
        ("no_enabled_grid", grid.where("enabled <> 'true' or rows <= 0 or cols <= 0").withColumn("detail", F.format_string("%s %d x %d", "enabled", "rows", "cols"))),
        ("index_twice", twice(raw, ["idx"], F.format_string("Index%d", "idx"))),
        ("no_file_path", raw.where("text is null").withColumn("detail", F.format_string("Index%d", "idx"))),
        ("outside_grid", raw.join(grid, "path").where("row < 0 or col < 0 or row >= rows or col >= cols").withColumn("detail", numbered("text"))),
        ("no_entries", grid.join(raw, "path", "left_anti").withColumn("detail", F.lit("no index members"))),
        ("no_tag", named.where("tag = ''").withColumn("detail", numbered("file"))),
        ("path_escapes", named.where(F.translate("file", "\\", "/").rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)")).withColumn("detail", numbered("file"))),
        ("tag_twice", twice(there, ["row", "col", "tag"], F.concat_ws(" ", slot, "tag"))),
        ("no_sources", grid.join(there, "path", "left_anti").withColumn("detail", F.lit("no named source exists"))),
        ("missing_files", named.join(sources.select("path", "file"), ["path", "file"], "left_anti").withColumn("detail", numbered("file"))),
        ("partial_grid", grid.join(slots, "path").where("n <> rows * cols").withColumn("detail", F.format_string("%d of %d places", "n", F.col("rows") * F.col("cols")))),
        ("sizes_differ", unlike(F.struct("h", "w"), [])),
        ("structure_differs", unlike(shape, ["tag"])),
        ("pixel_sizes_differ", sizes.where("size(py) > 1 or size(px) > 1").withColumn("detail", F.concat_ws(" ", F.transform(F.array_sort(F.concat("py", "px")), lambda v: v.cast("string"))))),
        ("tag_missing", lacking.withColumn("detail", F.concat_ws(" ", slot, "tag"))),
        ("stage_conflict", seen.where("x <> fx or y <> fy").withColumn("detail", F.concat_ws(" ", slot, "file"))),
    ]
    broken = None
    for k, (rule, rows) in enumerate(rules):
        order = F.col("idx") if "idx" in rows.columns else F.lit(0).cast("long")
        part = rows.select("path", F.lit(k).alias("k"), F.lit(rule).alias("rule"), order.alias("idx"), F.col("detail").cast("string").alias("detail"))
        broken = part if broken is None else broken.union(part)
    earliest = Window.partitionBy("path")
    shown = broken.withColumn("least", F.min("k").over(earliest)).where("k = least").withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("idx", "detail")))
    counted = shown.groupBy("path", "rule").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("at") <= MOST_SHOWN, F.struct("at", "detail")))).alias("d"))
    more = F.when(F.col("rows") > MOST_SHOWN, F.format_string("; and %d more", F.col("rows") - MOST_SHOWN)).otherwise("")
    refusals = counted.select("path", "rule", "rows", F.concat(F.concat_ws("; ", F.transform("d", lambda e: e["detail"])), more).alias("text"))
    good = grid.select("path").join(refusals, "path", "left_anti")

    declared = known.where("kind = 'count'").select("path", F.col("idx").alias("declared")).join(raw.groupBy("path").agg(F.count("*").alias("n")), "path", "left").where("declared <> coalesce(n, 0)")
    kinds = there.select("path", F.explode("channels").alias("c")).groupBy("path").agg(F.array_sort(F.collect_set("c.dtype")).alias("d")).where("size(d) > 1")
    label = lambda c: F.transform("channels", lambda e: F.coalesce(e[c], F.lit("")))
    warnings = [
        ("count_differs", declared.withColumn("detail", F.format_string("%d declared, %d there", "declared", F.coalesce("n", F.lit(0))))),
        ("labels_differ", unlike(label("label"), ["tag"])),
        ("colors_differ", unlike(label("color"), ["tag"])),
        ("stage_z_differs", seen.where("not z <=> fz").withColumn("detail", slot).select("path", "detail").distinct()),
        ("dtypes_mixed", kinds.withColumn("detail", F.concat_ws(", ", "d"))),
    ]
    told = None
    for rule, rows in warnings:
        part = rows.select("path", F.lit(rule).alias("rule"), "detail")
        told = part if told is None else told.union(part)
    kept = there.join(good, "path", "left_semi")
    stage = kept.join(placed, ["path", "file"], "left").groupBy("path", "row", "col").agg(F.min("idx").alias("idx"), F.min_by(F.struct("x", "y", "z"), F.when(F.col("x").isNotNull(), F.col("idx"))).alias("s"))
    tag_first = kept.groupBy("path", "tag").agg(F.min("idx").alias("first"), F.min_by("channels", F.struct("row", "col", "idx")).alias("channels"))
    order = Window.partitionBy("path").orderBy("first", "tag", "page")
    channels = tag_first.select("path", "tag", "first", F.explode("channels").alias("c")).select("path", "tag", "first", "c.*").withColumn("place", F.row_number().over(order)).drop("first")
    return Loaded(refusals, told.join(good, "path", "left_semi"), stage.select("path", "row", "col", "idx", "s.x", "s.y", "s.z"), kept.select("path", "row", "col", "tag", "file"), channels)
