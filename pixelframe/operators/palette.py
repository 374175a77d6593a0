"""Palettes on the pixels relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_rgb() -> Column:
    return F.col("r") * 65536 + F.col("g") * 256 + F.col("b")


def exact_palette(pixels: DataFrame, most: int = 256, threshold: int = 128) -> DataFrame:
    """(image_id, index, rgb, alpha): colours in the order in which they are first seen, the transparent entry last.

    Images with more than ``most`` entries have no rows. Colours are aggregated before they are ranked, so an
    image's window holds its colours and not its pixels.
    """
    place = F.col("y").cast("long") * F.col("width") + F.col("x")
    clear = F.col("a") < threshold
    colours = pixels.groupBy("image_id", F.when(clear, F.lit(-1)).otherwise(packed_rgb()).alias("rgb")).agg(F.min(place).alias("first"))
    by = Window.partitionBy("image_id")
    ranked = colours.withColumn("n", F.count("*").over(by)).where(F.col("n") <= most)
    order = by.orderBy((F.col("rgb") == -1).cast("int"), "first")
    ranked = ranked.withColumn("index", F.row_number().over(order) - 1)
    return ranked.select("image_id", "index", F.when(F.col("rgb") == -1, 0).otherwise(F.col("rgb")).alias("rgb"), F.when(F.col("rgb") == -1, 0).otherwise(255).alias("alpha"))


def indexed(pixels: DataFrame, palette: DataFrame, threshold: int = 128) -> DataFrame:
    """(image_id, y, x, index): each pixel's entry in the image's exact palette."""
    key = F.when(F.col("a") < threshold, F.lit(-1)).otherwise(packed_rgb())
    entries = palette.select("image_id", "index", F.when(F.col("alpha") == 0, F.lit(-1)).otherwise(F.col("rgb")).alias("key"))
    return pixels.withColumn("key", key).join(entries, ["image_id", "key"]).select("image_id", "y", "x", "index")


def indexed_to_pixels(indices: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b, a): colours looked up by an equality join; an index past the end means the last entry."""
    last = palette.groupBy("image_id").agg(F.max("index").alias("last"))
    clipped = indices.join(last, "image_id").withColumn("index", F.least("index", "last"))
    c = F.col("rgb")
    return clipped.join(palette, ["image_id", "index"]).select("image_id", "y", "x", F.shiftright(c, 16).alias("r"), F.shiftright(c, 8).bitwiseAND(F.lit(255)).alias("g"), c.bitwiseAND(F.lit(255)).alias("b"), F.col("alpha").alias("a"))


def histogram15(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    """(image_id, bin, n, sum_r, sum_g, sum_b) of the opaque pixels, by the five high bits of each channel."""
    seen = pixels.where(F.col("a") >= threshold)
    top = lambda c, s: F.shiftleft(F.shiftright(F.col(c), 3), s)
    return seen.groupBy("image_id", (top("r", 10) + top("g", 5) + top("b", 0)).alias("bin")).agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(f"sum_{c}") for c in "rgb"))


def nearest(pixels: DataFrame, colours: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Adds ``index``: the first of at most 256 given colours of least weighted distance. A projection, no join."""
    if not 1 <= len(colours) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    table = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(c) for c, v in zip("rgb", rgb, strict=True))) for i, rgb in enumerate(colours)))

    def scored(e: Column) -> Column:
        d = [F.col(c) - e[c] for c in "rgb"]
        return F.struct((d[0] * d[0] * 3 + d[1] * d[1] * 6 + d[2] * d[2]).alias("d"), e["i"].alias("i"))

    return pixels.withColumn("index", F.array_min(F.transform(table, scored))["i"])


def runs(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, length, rgba): runs of equal pixels within rows, as run-length coders see them."""
    key = (F.col("r").cast("long") * 16777216 + F.col("g") * 65536 + F.col("b") * 256 + F.col("a")).alias("rgba")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    marked = pixels.select("image_id", "y", "x", key).withColumn("new", (F.lag("rgba").over(row).isNull() | (F.lag("rgba").over(row) != F.col("rgba"))).cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(row))
    return numbered.groupBy("image_id", "y", "run").agg(F.min("x").alias("x"), F.count("*").alias("length"), F.first("rgba").alias("rgba")).drop("run")


def differences(pixels: DataFrame, along: str) -> DataFrame:
    """Each channel less that of the pixel to the left (``along`` x) or above (y), modulo 256: PNG's filters 1 and 2, TIFF's predictor."""
    other = "y" if along == "x" else "x"
    line = Window.partitionBy("image_id", other).orderBy(along)
    return pixels.withColumns({c: F.pmod(F.col(c) - F.coalesce(F.lag(c).over(line), F.lit(0)), F.lit(256)) for c in "rgba"})


def running_sums(pixels: DataFrame, along: str) -> DataFrame:
    """Undoes :func:`differences`: running sums modulo 256."""
    other = "y" if along == "x" else "x"
    line = Window.partitionBy("image_id", other).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumns({c: F.pmod(F.sum(c).over(line), F.lit(256)) for c in "rgba"})
