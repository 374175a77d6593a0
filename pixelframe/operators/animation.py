"""Animations as relations: frames composited pixel by pixel.

Each pixel of the canvas folds over its image's frames in order, inside one expression; pixels are independent, so an
animation is spread over as many tasks as it has pixels. What a group holds is the frames that touch one pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What becomes of a frame's rectangle before the next frame; how a frame is drawn.
KEEP, CLEAR, RESTORE = 0, 1, 2
SOURCE, OVER = 0, 1
_RGBA = "struct<r:int,g:int,b:int,a:int>"


def over(below: Column, above: Column) -> Column:
    """A pixel drawn over another, straight alpha, half up."""
    fa, ba = above["a"] / F.lit(255.0), below["a"] / F.lit(255.0)
    alpha = fa + ba * (1 - fa)
    mixed = lambda c: F.floor((above[c] * fa + below[c] * ba * (1 - fa)) / alpha + F.lit(0.5)).cast("int").alias(c)
    drawn = F.struct(mixed("r"), mixed("g"), mixed("b"), F.floor(alpha * 255 + F.lit(0.5)).cast("int").alias("a"))
    return F.when(above["a"] == 255, above).when(above["a"] == 0, below).otherwise(drawn)


def compose(frames: DataFrame, patches: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, frame, y, x, r, g, b, a) of every composited frame.

    ``frames``: image_id, frame (from 0 without gaps), dispose, blend. ``patches``: image_id, frame, y, x, r, g, b, a in
    canvas coordinates. Pixels that no frame touches stay transparent black.
    """
    listed = frames.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("frame", "dispose", "blend"))).alias("steps"))
    pixel = F.struct(*(F.col(c).cast("int").alias(c) for c in "rgba"))
    touched = patches.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).groupBy("image_id", "y", "x").agg(F.map_from_entries(F.collect_list(F.struct("frame", pixel))).alias("drawn"))
    nothing = F.lit(None).cast(f"map<int,{_RGBA}>")
    grid = listed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    joined = grid.join(touched, ["image_id", "y", "x"], "left").withColumn("drawn", F.coalesce("drawn", nothing))
    clear = F.struct(*(F.lit(0).alias(c) for c in "rgba"))
    start = F.struct(clear.alias("canvas"), F.array().cast(f"array<{_RGBA}>").alias("shown"))

    def step(state: Column, s: Column) -> Column:
        mine = F.try_element_at(F.col("drawn"), s["frame"])
        now = F.when(mine.isNull(), state["canvas"]).when(s["blend"] == OVER, over(state["canvas"], mine)).otherwise(mine)
        after = F.when(mine.isNull() | (s["dispose"] == KEEP), now).when(s["dispose"] == CLEAR, clear).otherwise(state["canvas"])
        return F.struct(after.alias("canvas"), F.concat(state["shown"], F.array(now)).alias("shown"))

    shown = F.aggregate("steps", start, step, lambda s: s["shown"])
    return joined.select("image_id", "y", "x", F.posexplode(shown).alias("frame", "p")).select("image_id", "frame", "y", "x", "p.*")
