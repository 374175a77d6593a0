"""Alpha, colour and light on the pixels relation: projections, and aggregations by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..raster import LUMINANCE, P3_TO_SRGB, SRGB_TO_P3
from .geometry import clamped, half_up

RGB = ("r", "g", "b")


def detect_alpha(pixels: DataFrame) -> DataFrame:
    """(image_id, has_alpha): whether some pixel is translucent."""
    return pixels.groupBy("image_id").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))


def flatten(pixels: DataFrame, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    a = F.col("a") / F.lit(255.0)
    mixed = {c: clamped(F.col(c) * a + F.lit(float(bg)) * (1 - a)) for c, bg in zip(RGB, background, strict=True)}
    return pixels.withColumns(mixed | {"a": F.lit(255)})


def attach_alpha(pixels: DataFrame, alpha: DataFrame) -> DataFrame:
    """The red of ``alpha`` as alpha, by place in reading order; pixels beyond its end keep theirs."""
    number = F.col("y") * F.col("width") + F.col("x")
    other = alpha.select("image_id", number.alias("n"), F.col("r").alias("new_a"))
    joined = pixels.withColumn("n", number).join(other, ["image_id", "n"], "left")
    return joined.withColumn("a", F.coalesce("new_a", "a")).select(*pixels.columns)


def harden_alpha(pixels: DataFrame, threshold: int = 128, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Under the threshold transparent black; above it composited and opaque."""
    a = F.col("a") / F.lit(255.0)
    seen = F.col("a") >= threshold
    out = {c: F.when(seen, clamped(F.col(c) * a + F.lit(float(bg)) * (1 - a))).otherwise(0) for c, bg in zip(RGB, background, strict=True)}
    return pixels.withColumns(out | {"a": F.when(seen, 255).otherwise(0)})


def linear(c: Column) -> Column:
    """A byte as linear light, as precise as a float32 table."""
    u = c / F.lit(255.0)
    return F.when(u <= 0.04045, u / F.lit(12.92)).otherwise(F.pow((u + F.lit(0.055)) / F.lit(1.055), F.lit(2.4))).cast("float").cast("double")


def encode_srgb(light: Column) -> Column:
    curve = F.when(light <= 0.0031308, light * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(light, F.lit(1 / 2.4)) - F.lit(0.055))
    return F.when(light <= 0, 0).when(light >= 1, 255).otherwise(half_up(curve * 255)).cast("int")


def _moved(channels: list[Column], matrix) -> list[Column]:
    return [F.lit(float(row[0])) * channels[0] + F.lit(float(row[1])) * channels[1] + F.lit(float(row[2])) * channels[2] for row in matrix]


def to_colour_space(pixels: DataFrame, to: str) -> DataFrame:
    """Bytes from the other space to ``to`` (``srgb`` or ``display-p3``)."""
    moved = _moved([linear(F.col(c)) for c in RGB], P3_TO_SRGB if to == "srgb" else SRGB_TO_P3)
    return pixels.withColumns({c: encode_srgb(v) for c, v in zip(RGB, moved, strict=True)})


def out_of_srgb_gamut(pixels: DataFrame) -> DataFrame:
    """(image_id, outside): the share of Display P3 pixels that sRGB cannot show."""
    moved = _moved([linear(F.col(c)) for c in RGB], P3_TO_SRGB)
    out = F.lit(False)
    for v in moved:
        out = out | (v < 0) | (v > 1)
    return pixels.groupBy("image_id").agg(F.avg(out.cast("double")).alias("outside"))


def to_light(pixels: DataFrame) -> DataFrame:
    """Bytes as linear light, alpha as 0..1; float32."""
    return pixels.withColumns({c: linear(F.col(c)).cast("float") for c in RGB} | {"a": (F.col("a") / F.lit(255.0)).cast("float")})


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.lit(float(LUMINANCE[0])) * r + F.lit(float(LUMINANCE[1])) * g + F.lit(float(LUMINANCE[2])) * b


def meter(light: DataFrame, stops: float = 0.0, clip: bool = False) -> DataFrame:
    """(image_id, exposure, white) by the log average of the lit pixels and the brightest one; one aggregation."""
    lum = luminance(*(F.col(c) for c in RGB))
    average = F.exp(F.avg(F.when(lum > 0, F.log(lum + F.lit(1e-6)))))
    found = light.groupBy("image_id").agg(F.coalesce(average, F.lit(0.18)).alias("average"), F.max(lum).alias("brightest"))
    exposure = F.lit(0.18) / F.greatest("average", F.lit(1e-6)) * F.lit(2.0**stops)
    white = F.lit(1.0) if clip else F.greatest(F.lit(1.0), F.col("brightest") * F.col("exposure"))
    return found.withColumn("exposure", exposure).select("image_id", "exposure", white.alias("white"))


def tone_map(light: DataFrame, stops: float = 0.0, clip: bool = False) -> DataFrame:
    """Bytes of scene light: metered, rolled off by Reinhard's extended curve (``clip`` leaves that out, not the metering)."""
    joined = light.join(meter(light, stops, clip), "image_id")
    r, g, b = (F.col(c) * F.col("exposure") for c in RGB)
    scale = F.lit(1.0)
    if not clip:
        lum = luminance(r, g, b)
        scale = F.when(lum > 0, (1 + lum / (F.col("white") * F.col("white"))) / (1 + lum)).otherwise(F.lit(1.0))
    out = {c: encode_srgb(v * scale) for c, v in zip(RGB, (r, g, b), strict=True)}
    alpha = F.least(F.greatest(half_up(F.col("a") * F.lit(255.0)), F.lit(0)), F.lit(255)).cast("int")
    return joined.withColumns(out | {"a": alpha}).drop("exposure", "white")
