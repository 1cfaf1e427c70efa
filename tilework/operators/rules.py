"""Rules on names, paths, sizes and lists as functions of columns or relations, with their limits as parameters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reserved file names, the signs that no file name may hold, and what write failures are called.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
FAILURES = {"Read-only file system": "read_only", "Permission denied": "no_permission", "No space left": "disk_full"}


# --- sizes -----------------------------------------------------------------------------------------------------------------
def overview_downsample(width: Column, height: Column, most_mpx: float = 16.0) -> Column:
    """The least power of two that brings an image down to most_mpx megapixels; no upper end."""
    need = F.sqrt(width.cast("double") * height / 1e6 / most_mpx)
    power = F.ceil(F.log2(F.greatest(need, F.lit(1.0))))
    power = F.when(F.pow(F.lit(2.0), power - 1) >= need, F.greatest(power - 1, F.lit(0))).when(F.pow(F.lit(2.0), power) < need, power + 1).otherwise(power)
    return F.pow(F.lit(2.0), power).cast("long")


def detail_downsample(width: Column, height: Column, magnification: Column, overview: Column, most: int = 6_000_000) -> Column:
    """The least stride from round(1 / magnification) on that leaves at most so many pixels; null where the overview shows as much."""
    start = F.greatest(F.lit(1), F.rint(1 / magnification)).cast("long")
    enough = F.ceil(F.sqrt(width.cast("double") * height / most)).cast("long")  # floors only make the area less
    first = F.element_at(F.filter(F.sequence(start, F.greatest(start, enough)), lambda d: F.floor(width / d) * F.floor(height / d) <= most), 1)
    return F.when(magnification * overview > 1.05, first)


def snapped_downsample(wanted: Column, tile: Column) -> Column:
    """The largest power of two that is at most wanted and divides the tile's side."""
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(wanted, F.lit(1)).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("long"))
    return F.array_max(F.filter(powers, lambda p: (p <= F.greatest(wanted, F.lit(1))) & (tile % p == 0)))


def scale_bar(limit: Column) -> Column:
    """The largest of 1, 2 and 5 times a power of ten that is at most limit; null without a limit."""
    ten = F.floor(F.log10(limit))
    candidates = F.transform(F.sequence(ten - 1, ten + 1), lambda e: F.transform(F.array(*[F.lit(m) for m in (1.0, 2.0, 5.0)]), lambda m: F.when(e < 0, m / F.pow(F.lit(10.0), -e)).otherwise(m * F.pow(F.lit(10.0), e))))
    return F.when(limit > 0, F.array_max(F.filter(F.flatten(candidates), lambda c: c <= limit)))


def visible_rectangle(pan_x: Column, pan_y: Column, zoom: Column, overview: Column, screen: tuple[int, int], full_w: Column, full_h: Column) -> Column:
    """x0, y0 (floor) and x1, y1 (ceiling) of what a screen shows of an image, inside the image."""

    def full(at, pan: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least((F.lit(at) - pan) / zoom * overview, most.cast("double")))

    return F.struct(F.floor(full(0, pan_x, full_w)).alias("x0"), F.floor(full(0, pan_y, full_h)).alias("y0"), F.ceil(full(screen[0], pan_x, full_w)).alias("x1"), F.ceil(full(screen[1], pan_y, full_h)).alias("y1"))


def packed_double(low: Column, high: Column) -> Column:
    """The number of the two 32-bit halves of a double of ordinary size."""
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(2047))
    fraction = (high.bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * 2.0**32 + low) / 2.0**52
    size = (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023)
    return F.when((exponent == 0) & (fraction == 0), F.lit(0.0)).otherwise(F.when(high >= 2**31, -size).otherwise(size))


def resized_field(field: DataFrame, keys: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """field(keys, y, x, v) of size at the grid of another size, bilinear, ends on ends."""

    def targets(n: int, m: int, axis: str) -> Column:
        """(t, weight) of the target places that a source place counts for."""
        step = (n - 1) / (m - 1) if m > 1 else 0.0
        at = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda t: F.struct(t.alias("t"), F.greatest(F.lit(0.0), 1 - F.abs(t * F.lit(step) - F.col(axis))).alias("w")))
        return F.filter(at, lambda e: e["w"] > 0)

    rows = field.withColumn("ty", F.explode(targets(size[0], to[0], "y"))).withColumn("tx", F.explode(targets(size[1], to[1], "x")))
    return rows.groupBy(*keys, F.col("ty.t").alias("y"), F.col("tx.t").alias("x")).agg(F.sum(F.col("v") * F.col("ty.w") * F.col("tx.w")).alias("v"))


# --- names and paths ---------------------------------------------------------------------------------------------------------
def safe_name(text: Column) -> Column:
    """A file name that every system takes; empty if nothing is left."""
    s = F.btrim(F.regexp_replace(F.btrim(F.coalesce(text, F.lit(""))), ILLEGAL, "_"), F.lit(" ."))
    return F.substring(F.when(F.upper(s).isin(RESERVED), F.concat(s, F.lit("_"))).otherwise(s), 1, 80)


def _whole_number(digits: Column) -> Column:
    """Orders runs of digits of any length as numbers: how many are left without leading zeros, then these."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.struct(F.length(bare).alias("length"), bare.alias("digits"))


def natural_key(text: Column) -> Column:
    """Sorts digits as numbers, however long, and the rest without case: pieces of (is a number, number, text)."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    none = F.struct(F.lit(0).alias("length"), F.lit("").alias("digits"))
    digits = lambda p: p.rlike(r"^\d")
    return F.transform(pieces, lambda p: F.struct(F.when(digits(p), 1).otherwise(0).alias("kind"), F.when(digits(p), _whole_number(p)).otherwise(none).alias("number"), F.when(digits(p), F.lit("")).otherwise(F.lower(p)).alias("text")))


def version_key(text: Column) -> Column:
    """Three numbers of a version, of any length, without v, build and pre-release; what is no number counts as 0."""
    parts = F.split(F.split(F.split(F.regexp_replace(F.btrim(text), r"^[vV]+", ""), r"\+")[0], "-")[0], r"\.")
    part = lambda i: F.btrim(F.coalesce(F.get(parts, i), F.lit("")))
    return F.array(*[_whole_number(F.when(part(i).rlike(r"^\d+$"), part(i)).otherwise("0")) for i in range(3)])


def text_filter(text: Column, needle: str) -> Column:
    """Holds the needle, in any case; a needle that ends in a digit is not followed by one more."""
    if not needle[-1:].isdigit():
        return F.contains(F.lower(text), F.lit(needle.lower()))
    # looked ahead, not split: what follows a needle may be the needle again, or begin inside it
    quoted = "\\Q" + needle.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.lower(text).rlike(quoted + r"(?!\d)")


def path_key(path: Column) -> Column:
    """The same for all spellings of an absolute path: no empty parts, none that stay, none that go up."""
    up = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def save_name(name: Column, wanted: Column, accepted: list[str]) -> Column:
    """name with the wanted ending, unless it has one that is accepted."""
    ends = [F.endswith(F.lower(name), F.lit(s)) for s in sorted(accepted, key=len, reverse=True)]
    fits = ends[0]
    for e in ends[1:]:
        fits = fits | e
    return F.when(fits | (wanted == ""), name).otherwise(F.concat(name, wanted))


def failure(text: Column, errno: Column) -> Column:
    """What a write failure is called; another message without the mark of unfinished files."""
    numbers = {"read_only": 30, "no_permission": 13, "disk_full": 28}
    out = None
    for sign, name in FAILURES.items():
        when = F.contains(text, F.lit(sign)) | F.coalesce(errno == numbers[name], F.lit(False))
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise(F.replace(text, F.lit(".part"), F.lit("")))


def plate_pdf_name(paths: Column, first_label: Column) -> Column:
    """The name of a plate's pages: of one capture, or of a series named after its first."""
    base = safe_name(F.coalesce(F.nullif(first_label, F.lit("")), F.element_at(F.split(F.element_at(paths, 1), "/"), -1)))
    return F.when(F.size(paths) == 1, F.concat(base, F.lit("_plate.pdf"))).otherwise(F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("plate")), F.lit("_plate_series.pdf")))


def unique_labels(captures: DataFrame) -> DataFrame:
    """captures(place, path) with label: the last two parts of the path, of more parts for each later one while that is taken."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used, labels = set(), []
        group = group.sort_values("place")
        for path in group["path"]:
            parts = path.strip("/").split("/")
            label = next((s for n in range(2, len(parts) + 1) if (s := "/".join(parts[-n:])) not in used), path)
            used.add(label)
            labels.append(label)
        return group.assign(label=labels)[["place", "path", "label"]]

    # only paths that end alike can take each other's label
    ends = F.array_join(F.slice(F.reverse(F.split("path", "/")), 1, 2), "/")
    return captures.select("place", "path").groupBy(ends.alias("ends")).applyInPandas(run, "place long, path string, label string")


# --- lists -----------------------------------------------------------------------------------------------------------------
def outermost(folders: DataFrame) -> DataFrame:
    """folders(dir) that lie in no other: each is joined with its ancestors by equality."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = folders.select("dir").distinct()
    inside = folders.select("dir", F.explode(above).alias("up")).where("up <> dir").join(folders.select(F.col("dir").alias("up")), "up", "left_semi")
    return folders.join(inside.select("dir"), "dir", "left_anti")


def ordered_columns(names: DataFrame) -> DataFrame:
    """names(plate, col) with place: numbers in their order; what is no number counts as 0, in order of name."""
    number = F.when(F.col("col").rlike(r"^\d+$"), F.col("col").cast("int")).otherwise(0)
    return names.distinct().withColumn("place", F.row_number().over(Window.partitionBy("plate").orderBy(number, "col")))


def moved(series: DataFrame, delta: int) -> DataFrame:
    """series(list, place, key, chosen): the chosen entry of each list moved by delta, if that is inside the list."""
    whole = Window.partitionBy("list")
    at = F.max(F.when(F.col("chosen"), F.col("place"))).over(whole)
    target = at + delta
    inside = (target >= 1) & (target <= F.count("*").over(whole))
    other = F.when((F.col("place") > at) & (F.col("place") <= target), F.col("place") - 1).when((F.col("place") < at) & (F.col("place") >= target), F.col("place") + 1).otherwise(F.col("place"))
    place = F.when(~F.coalesce(inside, F.lit(False)), F.col("place")).when(F.col("chosen"), target).otherwise(other)
    return series.withColumn("new_place", place.cast("int"))


def series_after(changes: DataFrame) -> DataFrame:
    """changes(step, path, included): the series after all of them, in order of adding. Adding what is there, or taking away
    what is not, changes nothing; paths are the same by path_key."""
    runs = changes.withColumn("key", path_key(F.col("path")))
    by = Window.partitionBy("key").orderBy("step")
    fresh = runs.withColumn("before", F.lag("included").over(by)).where("included and not coalesce(before, false)")
    added = fresh.groupBy("key").agg(F.max("step").alias("added"))
    last = runs.groupBy("key").agg(F.max_by("included", "step").alias("included")).where("included")
    return last.join(added, "key").select("key", "added")


def capture_groups(captures: DataFrame, root: str) -> DataFrame:
    """captures(path) below root by top folder: grp (empty for those right below it), label and place in natural order."""
    below = F.regexp_replace("path", "^" + root.rstrip("/") + "/", "")
    parts = F.split(below, "/")
    many = F.size(parts) > 1
    out = captures.select("path", F.when(many, parts[0]).otherwise("").alias("grp"), F.when(many, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")).otherwise(parts[0]).alias("label"))
    parent = F.element_at(F.split("path", "/"), -2)
    label = F.when((F.col("grp") == "") & F.col("label").rlike(r"(?i)^XY\d+$"), F.concat_ws(" / ", parent, "label")).otherwise(F.col("label"))
    out = out.withColumn("label", label)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(natural_key(F.col("label")), "path")))


def capture_facts(images: DataFrame) -> DataFrame:
    """images(capture, place, width, height, um): the largest side (1600 if none), the first aspect and the first calibration."""
    sized = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("place"))
    known = F.when(F.col("um") > 0, F.col("place"))
    largest = F.max(F.greatest("width", "height"))
    return images.groupBy("capture").agg(
        F.when(largest > 0, largest).otherwise(1600).alias("largest"),
        F.coalesce(F.min_by(F.col("height") / F.nullif(F.col("width"), F.lit(0)), sized), F.lit(1.0)).alias("aspect"),
        F.coalesce(F.min_by("um", known), F.lit(0.0)).alias("um"),
    )


def only_manifest(files: DataFrame, ending: str = ".gci") -> DataFrame:
    """files(dir, name) -> dir, manifest, error: the one file with the ending right in each folder."""
    fits = F.when(F.endswith(F.lower("name"), F.lit(ending)), F.col("name"))
    n = F.count(fits)
    return files.groupBy("dir").agg(F.when(n == 1, F.max(fits)).alias("manifest"), F.when(n == 0, "none").when(n > 1, "several").alias("error"))


def page_names(pages: DataFrame) -> DataFrame:
    """pages(file, channel, n_pages, names) -> file, page, name: the description's name, or channel[i] where it has none."""
    one = pages.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)))
    return one.select("file", "page", F.coalesce(F.nullif(F.get("names", F.col("page")), F.lit("")), F.concat("channel", F.lit("["), "page", F.lit("]"))).alias("name"))


def pixel_size(description: Column) -> Column:
    """Micrometres a pixel as the description says; 0 if it does not."""
    return F.coalesce(F.regexp_extract(F.coalesce(description, F.lit("")), r'PhysicalSizeX="([\d.]+)"', 1).try_cast("double"), F.lit(0.0))


def unusable(structural: DataFrame, readable: DataFrame, keys: list[str]) -> DataFrame:
    """What is there by name but cannot be read."""
    return structural.select(*keys).distinct().join(readable.select(*keys), keys, "left_anti")
