"""A Spark data source for tiled containers that reads only the tiles of a rectangle.

    spark.dataSource.register(TiledSource)
    spark.read.format("tiles").option("y0", 29).option("y1", 181).load(folder)

Rows are pixels (path, plane, tile, y, x, v). The rectangle comes from options; with the option pushdown, and
spark.sql.python.filterPushdown.enabled in the session, from comparisons of y, x and plane with constants in the query as well. Tasks open
files, read header and index, and then only the bytes of tiles that the rectangle touches; absent tiles read as 0.
Files are listed once; large ones are split into parts of about SPLIT bytes, small ones share a task, so the number of tasks
follows the bytes and no file is ever whole in memory. Files are opened through pyarrow.fs, which knows local paths and URIs of
the usual stores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tilework.sources import containers as C

SPLIT = 128 << 20
SCHEMA = "path string, plane int, tile int, y int, x int, v int"
FAR = 1 << 31


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, size) of the containers below a folder, or of one file; hidden files are left out."""
    store, root = fs.FileSystem.from_uri(path)
    lead = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    named = [f for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".ktf") and not f.base_name.startswith(".")]
    return sorted((lead + f.path, f.size) for f in named)


@dataclass
class Part(InputPartition):
    """(path, k, n): the k-th of n parts of a file's tiles."""

    pieces: list[tuple[str, int, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class TiledReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.stride = max(1, int(options.get("stride", 1)))
        #: bounds of each column, both included
        self.least = {"y": max(0, int(options.get("y0", 0))), "x": max(0, int(options.get("x0", 0))), "plane": int(options.get("plane", 0))}
        self.most = {"y": int(options.get("y1", FAR)) - 1, "x": int(options.get("x1", FAR)) - 1, "plane": int(options.get("plane", FAR))}
        self.start = dict(self.least)  # strides count from here
        self.tiles_read: list[tuple[str, int]] = []

    def partitions(self) -> list[Part]:
        parts, held, size = [], [], 0
        for path, n in files_below(self.path):
            pieces = max(1, -(-n // self.split))
            if pieces > 1:
                parts += [Part([(path, k, pieces)]) for k in range(pieces)]
                continue
            if held and size + n > self.split:
                parts.append(Part(held))
                held, size = [], 0
            held, size = [*held, (path, 0, 1)], size + n
        return parts + ([Part(held)] if held else [])

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for path, k, n in part.pieces:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                yield from self._file(path, f, k, n)

    def _file(self, path: str, f, k: int, n: int) -> Iterator[pa.RecordBatch]:
        try:
            head = C.header(f)
        except C.NoContainer:
            return  # containers.headers lists such files
        entries, side, end = C.tile_index(f, head), head["tile_size"], f.size()
        across, down = -(-head["width"] // side), -(-head["height"] // side)
        planes = max(1, entries[0][1] // side**2 if entries else 1)
        low = {c: self.least[c] // side for c in "yx"}
        high = {"y": min(down - 1, self.most["y"] // side), "x": min(across - 1, self.most["x"] // side)}
        for ty in range(low["y"], high["y"] + 1):
            for tx in range(low["x"], high["x"] + 1):
                tile = ty * across + tx
                if tile * n // (across * down) != k:
                    continue
                ys, xs = self._line("y", ty * side, min(head["height"], (ty + 1) * side)), self._line("x", tx * side, min(head["width"], (tx + 1) * side))
                if not len(ys) or not len(xs):
                    continue
                for plane in range(max(0, self.least["plane"]), min(planes - 1, self.most["plane"]) + 1):
                    got = C.read_tile(f, head, entries[tile], plane, end) if tile < len(entries) else None
                    if tile < len(entries):
                        self.tiles_read.append((path, tile))
                    v = np.zeros((len(ys), len(xs)), np.int32) if got is None else got[np.ix_(ys - ty * side, xs - tx * side)].astype(np.int32)
                    m = v.size
                    columns = [pa.array([path] * m), pa.array(np.full(m, plane, np.int32)), pa.array(np.full(m, tile, np.int32)), pa.array(np.repeat(ys, len(xs)).astype(np.int32)), pa.array(np.tile(xs, len(ys)).astype(np.int32)), pa.array(v.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "plane", "tile", "y", "x", "v"])

    def _line(self, axis: str, low: int, high: int) -> np.ndarray:
        """The sampled coordinates from low up to high."""
        low, high = max(low, self.least[axis]), min(high, self.most[axis] + 1)
        low += (self.start[axis] - low) % self.stride
        return np.arange(low, max(low, high), self.stride)


class PushedReader(TiledReader):
    """Takes bounds from the query too. Spark refuses such a reader where the session has push-down off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name in self.least and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least[name] = max(self.least[name], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most[name] = min(self.most[name], value - isinstance(f, LessThan))
            yield f  # Spark tests every row again


class TiledSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TiledReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown", "false") == "true" else TiledReader)(options)


def region(spark: SparkSession, path: str, y0: int = 0, x0: int = 0, y1: int = FAR, x1: int = FAR, stride: int = 1, plane: int = 0) -> DataFrame:
    """(path, oy, ox, v): every stride-th pixel of the rectangle (ends excluded) of all containers below path, from its corner.
    Pixels outside an image are not there."""
    spark.dataSource.register(TiledSource)
    options = {"y0": max(0, y0), "x0": max(0, x0), "y1": y1, "x1": x1, "stride": max(1, stride), "plane": plane}
    px = spark.read.format("tiles").options(**options).load(path)
    place = lambda c, start: F.expr(f"cast(({c} - {max(0, start)}) div {max(1, stride)} as int)")
    return px.select("path", place("y", y0).alias("oy"), place("x", x0).alias("ox"), "v")


def reconstructed(spark: SparkSession, path: str, downsample: int = 1, plane: int = 0, tile_size: int = 512) -> DataFrame:
    """(path, oy, ox, v) of whole images, every n-th pixel: n is the largest power of two of at most downsample that divides the tile
    size, so that the grid goes on across tiles."""
    n = 1
    while 2 * n <= max(1, downsample) and tile_size % (2 * n) == 0:
        n *= 2
    return region(spark, path, stride=n, plane=plane)
