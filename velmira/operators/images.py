"""Rules on image files and boxes: quality gate, renditions, duplicates, suppression, grids, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSION_ORDER = (".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff")


def failure_reason(least_mb: float = 0.001, most_mb: float = 50.0, least_px: int = 100, most_px: int = 4096) -> Column:
    """First failed check of an image row, or null; the order of the checks counts."""
    return (
        F.when(~F.col("file_exists"), "missing")
        .when(F.col("file_size_mb") < least_mb, "too_small_file")
        .when(F.col("file_size_mb") > most_mb, "too_large_file")
        .when(F.least("width", "height") < least_px, "too_small")
        .when(F.greatest("width", "height") > most_px, "too_large")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def best_rendition(images: DataFrame, path: str = "path") -> DataFrame:
    """One file per stem, the preferred type first, then the path; ``n_renditions`` counts them all."""
    ranks = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EXTENSION_ORDER)), extension(F.col(path))), F.lit(0)), F.lit(99))
    stem = F.regexp_replace(F.col(path), r"\.[A-Za-z0-9]+$", "")
    named = images.withColumns({"stem": stem, "rank": ranks})
    return named.groupBy("stem").agg(F.min(F.struct("rank", path))[path].alias("best"), F.count("*").alias("n_renditions"))


def duplicates(images: DataFrame, digest: str, path: str = "path") -> DataFrame:
    """``path, digest, is_duplicate``: all but the first path of equal digests."""
    first = F.row_number().over(Window.partitionBy(digest).orderBy(path))
    return images.where(F.col(digest).isNotNull()).select(path, digest, (first > 1).alias("is_duplicate"))


def iou(a: Column, b: Column) -> Column:
    width = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    height = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    shared = width * height
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def suppressed(boxes: DataFrame, image: str = "image_id", most: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression per image as a fold: boxes by falling score, one stays if it overlaps no kept
    box by more than ``most``.  Box columns: x1, y1, x2, y2, confidence."""
    box = F.struct((-F.col("confidence")).alias("o"), *("x1", "y1", "x2", "y2", "confidence"))
    per_image = boxes.groupBy(image).agg(F.array_sort(F.collect_list(box)).alias("b"))
    kept = F.aggregate("b", F.filter("b", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k, x) > most), acc).otherwise(F.concat(acc, F.array(x))))
    return per_image.select(image, F.inline(kept)).drop("o")


def grid_cells(lines: DataFrame, image: str = "image_id") -> DataFrame:
    """Cells between neighbouring vertical and horizontal lines (arrays ``v``, ``h`` without borders); cells of at
    most a tenth of the width or height are left out.  Columns width, height, v, h."""
    full = lambda edges, size: F.array_sort(F.concat(F.array(F.lit(0)), edges, F.array(size)))
    spans = lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.struct(F.element_at(e, i).alias("lo"), F.element_at(e, i + 1).alias("hi")))
    base = lines.withColumns({"__v": full(F.col("v"), F.col("width")), "__h": full(F.col("h"), F.col("height"))})
    cells = base.select(image, "width", "height", "__h", F.explode(spans(F.col("__v"))).alias("cx")).select(image, "width", "height", "cx", F.explode(spans(F.col("__h"))).alias("cy"))
    out = cells.select(image, F.col("cx.lo").alias("x1"), F.col("cy.lo").alias("y1"), F.col("cx.hi").alias("x2"), F.col("cy.hi").alias("y2"), "width", "height")
    return out.where((F.col("x2") - F.col("x1") > F.col("width") * 0.1) & (F.col("y2") - F.col("y1") > F.col("height") * 0.1)).drop("width", "height")


def decision(scores: Column, wanted: int, accept: float = 1.5, reject: float = 1.5, floor: float = 0.0005) -> Column:
    """ACCEPT if the best of all scores is a wanted one (the first ``wanted``), reaches ``floor`` and ``accept`` times the
    best other one; REJECT if it is another one and ``reject`` times the best wanted one; else BORDERLINE."""
    good, bad = F.array_max(F.slice(scores, 1, wanted)), F.array_max(F.slice(scores, wanted + 1, 1000))
    least = F.lit(1e-8)
    on_top = F.array_position(scores, F.array_max(scores)) <= wanted
    return (
        F.when(on_top & (good >= floor) & (good / F.greatest(bad, least) >= accept), "ACCEPT")
        .when(~on_top & (bad / F.greatest(good, least) >= reject), "REJECT")
        .otherwise("BORDERLINE")
    )


def kind_of_best(scores: Column, kinds: list[str]) -> Column:
    """The kind (one per score) of the best score; of equal ones the first."""
    return F.get(F.array(*map(F.lit, kinds)), F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def aspect_grid(width: Column, height: Column) -> Column:
    """``array<struct<x1, y1, x2, y2, confidence, label>>``: panels guessed from the shape of a figure alone: four of a nearly
    square one, two side by side of a wide one, two above each other of a tall one, else the whole."""
    w, h = width.cast("int"), height.cast("int")
    half_w, half_h, zero = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int"), F.lit(0)
    aspect = w / h

    def boxes(*corners, sure=0.7, label="subfigure"):
        names = ("x1", "y1", "x2", "y2")
        return F.array(*(F.struct(*(c.alias(n) for n, c in zip(names, box)), F.lit(sure).alias("confidence"), F.lit(label).alias("label")) for box in corners))

    four = boxes((zero, zero, half_w, half_h), (half_w, zero, w, half_h), (zero, half_h, half_w, h), (half_w, half_h, w, h))
    return (
        F.when(aspect.between(0.8, 1.2), four)
        .when(aspect > 1.5, boxes((zero, zero, half_w, h), (half_w, zero, w, h)))
        .when(aspect < 0.67, boxes((zero, zero, w, half_h), (zero, half_h, w, h)))
        .otherwise(boxes((zero, zero, w, h), sure=1.0, label="single_panel"))
    )


def renditions(images: DataFrame, path: str = "path") -> DataFrame:
    """``stem, paths, n_types`` of the stems that exist in more than one file type; ``paths`` in order."""
    stem = F.regexp_replace(F.col(path), r"\.[A-Za-z0-9]+$", "")
    held = images.where(F.col(path).isNotNull()).groupBy(stem.alias("stem")).agg(F.sort_array(F.collect_set(path)).alias("paths"), F.count_distinct(extension(F.col(path))).alias("n_types"))
    return held.where("n_types > 1")


def first_of_each(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each ``by`` in the order of ``order``, by a partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row")).select(*by, "__row.*")


def image_size(content: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from the header of a PNG, GIF, BMP or JPEG file; nulls for anything else."""
    import struct

    data = content or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("PNG", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("GIF", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return ("BMP", width, abs(height))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("JPEG", width, height)
        at += 2 + size if marker != 0xFF else 1
    return (None, None, None)


def image_files(files: DataFrame) -> DataFrame:
    """``path, file_exists, file_size_mb, format, width, height, digest`` of rows of the ``binaryFile`` source."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            sizes = [image_size(c) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "bytes": frame["length"], "digest": frame["digest"], "format": [x[0] for x in sizes], "width": [x[1] for x in sizes], "height": [x[2] for x in sizes]})

    # the header is all that Python needs of a file
    head = files.select("path", "length", F.md5("content").alias("digest"), F.substring("content", 1, 1 << 16).alias("content"))
    read = head.mapInPandas(run, "path string, bytes bigint, digest string, format string, width int, height int")
    return read.select("path", F.lit(True).alias("file_exists"), (F.col("bytes") / (1 << 20)).alias("file_size_mb"), "format", "width", "height", "digest")
