"""Geometry on the pixels relation (image_id, width, height, y, x, r, g, b, a).

Crops, turns and mirrors are projections: no shuffle. A resize sends each pixel to the few outputs whose
footprint it lies in, so that there is no join at all; both of its aggregations are by image, and one
exchange serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def clamped(x: Column) -> Column:
    """Cut to 0..255 and rounded to even, as a byte."""
    return F.least(F.greatest(F.bround(x, 0), F.lit(0.0)), F.lit(255.0)).cast("int")


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The window, cut at the image's edge; pixels outside the image do not exist."""
    inside = pixels.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y, "width": F.lit(width), "height": F.lit(height)})


def rotate(pixels: DataFrame, degrees: int) -> DataFrame:
    """Anticlockwise by a multiple of 90."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    turned = {
        0: {},
        90: {"x": y, "y": w - 1 - x, "width": h, "height": w},
        180: {"x": w - 1 - x, "y": h - 1 - y},
        270: {"x": h - 1 - y, "y": x, "width": h, "height": w},
    }[degrees % 360]
    return pixels.withColumns(turned) if turned else pixels


def mirror(pixels: DataFrame, axis: str | None) -> DataFrame:
    """``horizontal`` swaps left and right."""
    if not axis:
        return pixels
    side, size = ("x", "width") if axis == "horizontal" else ("y", "height")
    return pixels.withColumn(side, F.col(size) - 1 - F.col(side))


def orient(pixels: DataFrame, exif: str | Column) -> DataFrame:
    """Upright by each row's EXIF orientation (1 to 8): the mirror first, then the turn."""
    e = F.col(exif) if isinstance(exif, str) else exif
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    flat = e.isin(5, 6, 7, 8)
    to_x = F.when(e.isin(2, 3), w - 1 - x).when(e.isin(5, 8), y).when(e.isin(6, 7), h - 1 - y).otherwise(x)
    to_y = F.when(e.isin(3, 4), h - 1 - y).when(e.isin(5, 6), x).when(e.isin(7, 8), w - 1 - x).otherwise(y)
    return pixels.withColumns({"x": to_x, "y": to_y, "width": F.when(flat, h).otherwise(w), "height": F.when(flat, w).otherwise(h)})


def blit(target: DataFrame, tiles: DataFrame) -> DataFrame:
    """``target`` overwritten by ``tiles`` (image_id, y, x and channels, already in its coordinates); what lies outside is cut."""
    over = tiles.select("image_id", "y", "x", *(F.col(c).alias(f"t_{c}") for c in CHANNELS))
    joined = target.join(over, ["image_id", "y", "x"], "left")
    drawn = {c: F.coalesce(F.col(f"t_{c}"), F.col(c)) for c in CHANNELS}
    return joined.withColumns(drawn).select(*target.columns)


def fit_longest_side(width: Column, height: Column, longest: float) -> Column:
    """(width, height) of at most ``longest``, never larger, at least one pixel."""
    most = F.greatest(width, height)
    scale = F.lit(float(longest)) / most
    fit = lambda n: F.greatest(F.lit(1), half_up(n * scale)).cast("int")
    small = (most > longest) & F.lit(longest >= 1)
    return F.struct(F.when(small, fit(width)).otherwise(width).cast("int").alias("width"), F.when(small, fit(height)).otherwise(height).cast("int").alias("height"))


def _spread(rows: DataFrame, side: str, size: str, to: str, channels: dict[str, Column]) -> DataFrame:
    """One pass of the box filter along ``side``; premultiplied channels in, float32 averages out."""
    n, m, s = F.col(size), F.col(to), F.col(side).cast("double")
    scale = n / m.cast("double")
    radius = F.greatest(scale, F.lit(1.0)) / 2
    first = F.greatest(F.ceil((s - radius) / scale - 0.5) - 1, F.lit(0))
    last = F.least(F.floor((s + 1 + radius) / scale - 0.5) + 1, m.cast("long") - 1)
    out = rows.withColumn("to_at", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    centre = (F.col("to_at") + F.lit(0.5)) * scale
    weight = F.least(s + 1, centre + radius) - F.greatest(s, centre - radius)
    out = out.withColumn("weight", weight).where("weight > 0").withColumnRenamed(side, "from_at").withColumnRenamed("to_at", side)
    keys = ["image_id", "y", "x", "width", "height", "to_width", "to_height"]
    parts = F.struct("from_at", "weight", *((v * F.col("weight")).alias(c) for c, v in channels.items()))
    # Added in place order: a float sum depends on the order, and a shuffle's is not stable.
    names = ("weight", *channels)
    start = F.struct(*(F.lit(0.0).alias(c) for c in names))
    added = F.aggregate("parts", start, lambda t, p: F.struct(*((t[c] + p[c]).alias(c) for c in names)))
    sums = out.groupBy(*keys).agg(F.sort_array(F.collect_list(parts)).alias("parts")).select(*keys, added.alias("t"))
    return sums.select(*keys, *((F.col("t")[c] / F.col("t.weight")).cast("float").alias(c) for c in channels))


def resize(pixels: DataFrame, width: str | Column | int, height: str | Column | int) -> DataFrame:
    """Separable box filter on premultiplied colour, float32 between the passes. The new size may differ by row of ``pixels``' images."""
    of = lambda v: F.lit(v) if isinstance(v, int) else F.col(v) if isinstance(v, str) else v
    rows = pixels.withColumns({"to_width": of(width), "to_height": of(height)}).repartition("image_id")
    alpha = F.col("a").cast("double")
    pre = {c: F.col(c).cast("double") * alpha * F.lit(1 / 255) for c in CHANNELS[:3]} | {"a": alpha}
    one = _spread(rows, "x", "width", "to_width", pre)
    two = _spread(one, "y", "height", "to_height", {c: F.col(c).cast("double") for c in CHANNELS})
    a = F.col("a").cast("double")
    colour = {c: F.when(a > 0, half_up(F.col(c).cast("double") * (F.lit(255.0) / a))).otherwise(F.lit(0)).cast("int") for c in CHANNELS[:3]}
    return two.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height"), "y", "x", *(v.alias(c) for c, v in colour.items()), half_up(a).cast("int").alias("a"))


def resize_light(light: DataFrame, width: str | Column | int, height: str | Column | int) -> DataFrame:
    """As :func:`resize` on linear light: alpha is 0 to 1 and nothing is rounded but to float32."""
    of = lambda v: F.lit(v) if isinstance(v, int) else F.col(v) if isinstance(v, str) else v
    rows = light.withColumns({"to_width": of(width), "to_height": of(height)}).repartition("image_id")
    alpha = F.col("a").cast("double")
    one = _spread(rows, "x", "width", "to_width", {c: F.col(c).cast("double") * alpha for c in CHANNELS[:3]} | {"a": alpha})
    two = _spread(one, "y", "height", "to_height", {c: F.col(c).cast("double") for c in CHANNELS})
    a = F.col("a").cast("double")
    colour = {c: F.when(a > 0, F.col(c).cast("double") / a).otherwise(F.lit(0.0)).cast("float") for c in CHANNELS[:3]}
    return two.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height"), "y", "x", *(v.alias(c) for c, v in colour.items()), "a")


def fit_square(pixels: DataFrame, side: int) -> DataFrame:
    """Letterboxed into a square; the rim is transparent black."""
    scale = F.least(F.lit(float(side)) / F.col("width"), F.lit(float(side)) / F.col("height"))
    fit = lambda c: F.greatest(F.lit(1), half_up(F.col(c) * scale)).cast("int")
    small = resize(pixels, fit("width"), fit("height"))
    placed = small.select("image_id", (F.col("y") + F.floor((side - F.col("height")) / 2)).cast("int").alias("y"), (F.col("x") + F.floor((side - F.col("width")) / 2)).cast("int").alias("x"), *CHANNELS)
    ids = pixels.select("image_id").distinct()
    empty = ids.select("image_id", F.lit(side).alias("width"), F.lit(side).alias("height"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    return blit(empty.withColumns({c: F.lit(0) for c in CHANNELS}), placed)
