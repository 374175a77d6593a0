"""The library's queries over the given tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, naming
from ..operators import animation, colour, geometry, palette
from ..registry import default_registry
from ..sources import images as sources
from .convert import Settings, convert
from .synth import SQL, folded, light_pixels, table, text_pixels
from .synth import images as synth_images
from .synth import light_images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None, plain: bool = False):
    """Registers a query and the tail of its SQL, which begins after the synthesised tables (``plain``: it stands alone)."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if plain else SQL + sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _checked(pixels: DataFrame) -> DataFrame:
    """One row for each image: its size and a checksum that depends on every pixel's place."""
    return pixels.groupBy("image_id").agg(F.max("width").cast("int").alias("width"), F.max("height").cast("int").alias("height"), F.count("*").alias("n"), _checksum())


def _checksum():
    at = F.col("y").cast("long") * F.col("width") + F.col("x") + 1
    value = F.col("r").cast("long") + F.col("g").cast("long") * 256 + F.col("b").cast("long") * 65536 + F.col("a").cast("long") * 16777216
    return F.sum(F.pmod(at * value, F.lit(1000003))).alias("checksum")


CHECK = "max(width)::INT AS width, max(height)::INT AS height, count(*) AS n, sum(((y * width + x + 1)::BIGINT * (r::BIGINT + 256 * g::BIGINT + 65536 * b::BIGINT + 16777216 * a::BIGINT)) % 1000003)::BIGINT AS checksum"


def _projected(name: str, make: Callable[[DataFrame], DataFrame], columns: str, where: str = "TRUE", source: str = "pa") -> None:
    """A query that checks ``make`` of the synthesised pixels against SQL that projects ``columns``."""
    variant = {"px": {}, "pa": {"alpha": True}, "pf": {"alpha": True, "few": True}}[source]

    def f(spark: SparkSession, d: str) -> DataFrame:
        return _checked(make(text_pixels(_docs(spark, d), **variant)))

    _query(name, f", q AS (SELECT image_id, {columns} FROM {source} WHERE {where}) SELECT image_id, {CHECK} FROM q GROUP BY image_id")(f)


_projected("q_synth_text_raster", lambda p: p, "width, height, y, x, r, g, b, a", source="px")
_projected("q_crop", lambda p: geometry.crop(p, 3, 2, 9, 7), "9 AS width, 7 AS height, y - 2 AS y, x - 3 AS x, r, g, b, a", "x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 8")
_projected("q_rotate90", lambda p: geometry.rotate(p, 90), "height AS width, width AS height, width - 1 - x AS y, y AS x, r, g, b, a")
_projected("q_rotate180", lambda p: geometry.rotate(p, 180), "width, height, height - 1 - y AS y, width - 1 - x AS x, r, g, b, a")
_projected("q_rotate270", lambda p: geometry.rotate(p, 270), "height AS width, width AS height, x AS y, height - 1 - y AS x, r, g, b, a")
_projected("q_mirror_h", lambda p: geometry.mirror(p, "horizontal"), "width, height, y, width - 1 - x AS x, r, g, b, a")
_projected("q_mirror_v", lambda p: geometry.mirror(p, "vertical"), "width, height, height - 1 - y AS y, x, r, g, b, a")
_projected(
    "q_orientation_exif",
    lambda p: geometry.orient(p, (F.pmod("image_id", F.lit(8)) + 1).cast("int")),
    """CASE WHEN image_id % 8 + 1 >= 5 THEN height ELSE width END AS width, CASE WHEN image_id % 8 + 1 >= 5 THEN width ELSE height END AS height,
    CASE image_id % 8 + 1 WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN height - 1 - y WHEN 4 THEN height - 1 - y WHEN 5 THEN x WHEN 6 THEN x ELSE width - 1 - x END AS y,
    CASE image_id % 8 + 1 WHEN 1 THEN x WHEN 2 THEN width - 1 - x WHEN 3 THEN width - 1 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN height - 1 - y WHEN 7 THEN height - 1 - y ELSE y END AS x, r, g, b, a""",
)
_FLAT = "greatest(0, least(255, round_even({c} * (a / 255::DOUBLE) + {v}::DOUBLE * (1 - a / 255::DOUBLE), 0)))::INT AS {c}"
_projected("q_flatten_white", colour.flatten, "width, height, y, x, " + ", ".join(_FLAT.format(c=c, v=255) for c in "rgb") + ", 255 AS a")
_projected("q_flatten_bg", lambda p: colour.flatten(p, (10, 120, 200)), "width, height, y, x, " + ", ".join(_FLAT.format(c=c, v=v) for c, v in zip("rgb", (10, 120, 200), strict=True)) + ", 255 AS a")
_HARD = "CASE WHEN a >= 128 THEN greatest(0, least(255, round_even({c} * (a / 255::DOUBLE) + 255::DOUBLE * (1 - a / 255::DOUBLE), 0)))::INT ELSE 0 END AS {c}"
_projected("q_harden_alpha", colour.harden_alpha, "width, height, y, x, " + ", ".join(_HARD.format(c=c) for c in "rgb") + ", CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a")
_projected("q_xbm_bits", lambda p: p.withColumns({"r": F.lit(0), "g": F.lit(0), "b": F.lit(0), "a": F.when((F.col("a") >= 128) & (F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114 < 128), 255).otherwise(0)}), "width, height, y, x, 0 AS r, 0 AS g, 0 AS b, CASE WHEN a >= 128 AND r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE < 128 THEN 255 ELSE 0 END AS a")


def _matrix_sql(matrix) -> str:
    lin = "CASE WHEN {c} / 255::DOUBLE <= 0.04045::DOUBLE THEN {c} / 255::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    rows = [" + ".join(f"{m!r}::DOUBLE * l{c}" for m, c in zip(map(float, row), "rgb", strict=True)) for row in matrix]
    enc = lambda c, v: f"CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 1 THEN 255 ELSE floor((CASE WHEN {v} <= 0.0031308::DOUBLE THEN ({v}) * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END) * 255 + 0.5::DOUBLE) END::INT AS {c}"
    return f", lin AS (SELECT *, {', '.join(f'(({lin.format(c=c)})::FLOAT)::DOUBLE AS l{c}' for c in 'rgb')} FROM pa), mov AS (SELECT *, {', '.join(f'({v}) AS m{c}' for c, v in zip('rgb', rows, strict=True))} FROM lin), q AS (SELECT image_id, width, height, y, x, {', '.join(enc(c, f'm{c}') for c in 'rgb')}, a FROM mov)"


def _space_query(name: str, to: str, matrix) -> None:
    _query(name, _matrix_sql(matrix) + f" SELECT image_id, {CHECK} FROM q GROUP BY image_id")(lambda spark, d: _checked(colour.to_colour_space(text_pixels(_docs(spark, d), alpha=True), to)))


_space_query("q_p3_to_srgb", "srgb", colour.P3_TO_SRGB)
_space_query("q_srgb_to_p3", "display-p3", colour.SRGB_TO_P3)


@_query("q_out_of_gamut", _matrix_sql(colour.P3_TO_SRGB) + " SELECT image_id, round(avg(CASE WHEN mr < 0 OR mr > 1 OR mg < 0 OR mg > 1 OR mb < 0 OR mb > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS outside FROM mov GROUP BY image_id")
def q_out_of_gamut(spark: SparkSession, d: str) -> DataFrame:
    return colour.out_of_srgb_gamut(text_pixels(_docs(spark, d), alpha=True)).withColumn("outside", F.round("outside", 6))


@_query("q_detect_alpha", " SELECT image_id, bool_or(a <> 255) AS has_alpha FROM pa GROUP BY image_id")
def q_detect_alpha(spark: SparkSession, d: str) -> DataFrame:
    return colour.detect_alpha(text_pixels(_docs(spark, d), alpha=True))


@_query("q_attach_alpha", f", q AS (SELECT p.image_id, p.width, p.height, p.y, p.x, p.r, p.g, p.b, f.r AS a FROM px p JOIN pf f USING (image_id, y, x)) SELECT image_id, {CHECK} FROM q GROUP BY image_id")
def q_attach_alpha(spark: SparkSession, d: str) -> DataFrame:
    return _checked(colour.attach_alpha(text_pixels(_docs(spark, d)), text_pixels(_docs(spark, d), alpha=True, few=True)))


@_query("q_blit_clip", f", q AS (SELECT p.image_id, p.width, p.height, p.y, p.x, coalesce(t.r, p.r) AS r, coalesce(t.g, p.g) AS g, coalesce(t.b, p.b) AS b, coalesce(t.a, p.a) AS a FROM px p LEFT JOIN (SELECT image_id, y + 7 AS y, x + 10 AS x, r, g, b, a FROM pf) t ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.x) SELECT image_id, {CHECK} FROM q GROUP BY image_id")
def q_blit_clip(spark: SparkSession, d: str) -> DataFrame:
    tile = text_pixels(_docs(spark, d), alpha=True, few=True).withColumns({"x": F.col("x") + 10, "y": F.col("y") + 7})
    return _checked(geometry.blit(text_pixels(_docs(spark, d)), tile))


def _resize_sql(w: str, h: str, end: str = "") -> str:
    """Two passes over footprints; ``w`` and ``h`` are SQL for the new size."""

    def footprint(name: str, size: int, to: str) -> str:
        return f"""{name} AS (SELECT i, s, least(s + 1, (i + 0.5::DOUBLE) * sc + rd) - greatest(s, (i + 0.5::DOUBLE) * sc - rd) AS w
          FROM (SELECT i, s, {size} / {to}::DOUBLE AS sc, greatest({size} / {to}::DOUBLE, 1::DOUBLE) / 2 AS rd FROM (SELECT unnest(range({to})) AS i), (SELECT unnest(range({size})) AS s)))"""

    pre = ", ".join(f"{c} * (a * {1 / 255!r}::DOUBLE) AS {c}" for c in "rgb")
    one = ", ".join(f"(sum({c} * w ORDER BY s) / sum(w ORDER BY s))::FLOAT::DOUBLE AS {c}" for c in "rgba")
    out = ", ".join(f"CASE WHEN a > 0 THEN floor({c} * (255::DOUBLE / a) + 0.5::DOUBLE) ELSE 0 END::INT AS {c}" for c in "rgb")
    return f""", {footprint("fx", 16, w)}, {footprint("fy", 12, h)},
    pre AS (SELECT image_id, y, x, {pre}, a::DOUBLE AS a FROM pa),
    one AS (SELECT image_id, y, i AS x, {one} FROM pre JOIN fx ON fx.s = x AND fx.w > 0 GROUP BY image_id, y, i),
    two AS (SELECT image_id, i AS y, x, {one} FROM one JOIN fy ON fy.s = y AND fy.w > 0 GROUP BY image_id, x, i),
    q AS (SELECT image_id, {w} AS width, {h} AS height, y, x, {out}, floor(a + 0.5::DOUBLE)::INT AS a FROM two)""" + (end or f" SELECT image_id, {CHECK} FROM q GROUP BY image_id")


for _name, _w, _h in (("q_resize_half", 8, 6), ("q_resize_uneven", 7, 5), ("q_resize_up", 20, 17)):
    _query(_name, _resize_sql(str(_w), str(_h)))(lambda spark, d, w=_w, h=_h: _checked(geometry.resize(text_pixels(_docs(spark, d), alpha=True), w, h)))


def _light_sql(w: int, h: int) -> str:
    """The two passes on light, with an alpha that differs by place."""

    def footprint(name: str, size: int, to: int) -> str:
        return f"""{name} AS (SELECT i, s, least(s + 1, (i + 0.5::DOUBLE) * sc + rd) - greatest(s, (i + 0.5::DOUBLE) * sc - rd) AS w
          FROM (SELECT i, s, {size} / {to}::DOUBLE AS sc, greatest({size} / {to}::DOUBLE, 1::DOUBLE) / 2 AS rd FROM (SELECT unnest(range({to})) AS i), (SELECT unnest(range({size})) AS s)))"""

    one = ", ".join(f"(sum({c} * w ORDER BY s) / sum(w ORDER BY s))::FLOAT::DOUBLE AS {c}" for c in "rgba")
    return f""", {footprint("fx", 8, w)}, {footprint("fy", 8, h)},
    seen AS (SELECT image_id, y, x, r, g, b, ((x + 2 * y) % 5) / 4::DOUBLE AS a FROM light),
    pre AS (SELECT image_id, y, x, r * a AS r, g * a AS g, b * a AS b, a FROM seen),
    one AS (SELECT image_id, y, i AS x, {one} FROM pre JOIN fx ON fx.s = x AND fx.w > 0 GROUP BY image_id, y, i),
    two AS (SELECT image_id, i AS y, x, {one} FROM one JOIN fy ON fy.s = y AND fy.w > 0 GROUP BY image_id, x, i)
    SELECT image_id, {w} AS width, {h} AS height, y::INT AS y, x::INT AS x, {", ".join(f"round((CASE WHEN a > 0 THEN {c} / a ELSE 0 END)::FLOAT::DOUBLE, 4) AS {c}" for c in "rgb")}, round(a, 4) AS a FROM two"""


@_query("q_resize_light", _light_sql(5, 3))
def q_resize_light(spark: SparkSession, d: str) -> DataFrame:
    light = light_pixels(table(spark, d, "embeddings")).withColumn("a", F.pmod(F.col("x") + 2 * F.col("y"), F.lit(5)) / F.lit(4.0))
    return geometry.resize_light(light, 5, 3).withColumns({c: F.round(F.col(c).cast("double"), 4) for c in "rgba"})


@_query("q_fit_square", _resize_sql("9", "7", f""", sq AS (SELECT i.image_id, 9 AS width, 9 AS height, yy AS y, xx AS x, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b, coalesce(q.a, 0) AS a
    FROM (SELECT DISTINCT image_id FROM px) i, (SELECT unnest(range(9)) AS yy), (SELECT unnest(range(9)) AS xx) LEFT JOIN q ON q.image_id = i.image_id AND q.y + 1 = yy AND q.x = xx) SELECT image_id, {CHECK} FROM sq GROUP BY image_id"""))
def q_fit_square(spark: SparkSession, d: str) -> DataFrame:
    return _checked(geometry.fit_square(text_pixels(_docs(spark, d), alpha=True), 9))


@_query("q_fit_longest", """SELECT p_partkey, CASE WHEN greatest(w, h) > 640 THEN greatest(1, floor(w * (640::DOUBLE / greatest(w, h)) + 0.5))::INT ELSE w END AS width, CASE WHEN greatest(w, h) > 640 THEN greatest(1, floor(h * (640::DOUBLE / greatest(w, h)) + 0.5))::INT ELSE h END AS height
    FROM (SELECT p_partkey, (p_partkey * 37 % 3000 + 1)::INT AS w, (p_partkey * 101 % 2000 + 1)::INT AS h FROM part)""", plain=True)
def q_fit_longest(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 3000 + 1).cast("int").alias("w"), (F.col("p_partkey") * 101 % 2000 + 1).cast("int").alias("h"))
    return sized.select("p_partkey", geometry.fit_longest_side(F.col("w"), F.col("h"), 640).alias("s")).select("p_partkey", "s.*")


# ---------------------------------------------------------------- light

_LUM = "(0.2126::DOUBLE * {r} + 0.7152::DOUBLE * {g} + 0.0722::DOUBLE * {b})"


def _tone_sql(stops: float, clip: bool, end: str) -> str:
    lum = _LUM.format(r="r", g="g", b="b")
    white = "1::DOUBLE" if clip else "greatest(1::DOUBLE, brightest * exposure)"
    l = _LUM.format(r="er", g="eg", b="eb")
    scale = "1::DOUBLE" if clip else f"CASE WHEN {l} > 0 THEN (1 + {l} / (white * white)) / (1 + {l}) ELSE 1 END"
    enc = lambda v: f"CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 1 THEN 255 ELSE floor((CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END) * 255 + 0.5::DOUBLE) END::INT"
    return f""", met0 AS (SELECT image_id, coalesce(exp(avg(ln({lum} + 1e-6::DOUBLE)) FILTER ({lum} > 0)), 0.18::DOUBLE) AS average, max({lum}) AS brightest FROM light GROUP BY image_id),
    met1 AS (SELECT *, 0.18::DOUBLE / greatest(average, 1e-6::DOUBLE) * {2.0**stops!r}::DOUBLE AS exposure FROM met0), met AS (SELECT *, {white} AS white FROM met1),
    ex AS (SELECT l.image_id, width, height, y, x, r * exposure AS er, g * exposure AS eg, b * exposure AS eb, white, a FROM light l JOIN met USING (image_id)),
    sc AS (SELECT *, {scale} AS k FROM ex), q0 AS (SELECT image_id, width, height, y, x, er * k AS mr, eg * k AS mg, eb * k AS mb FROM sc),
    q AS (SELECT image_id, width, height, y, x, {enc("mr")} AS r, {enc("mg")} AS g, {enc("mb")} AS b, 255 AS a FROM q0)""" + end


@_query("q_tonemap_meter", _tone_sql(0.0, False, " SELECT image_id, round(exposure, 6) AS exposure, round(white, 6) AS white FROM met"))
def q_tonemap_meter(spark: SparkSession, d: str) -> DataFrame:
    return colour.meter(light_pixels(table(spark, d, "embeddings"))).select("image_id", F.round("exposure", 6).alias("exposure"), F.round("white", 6).alias("white"))


for _name, _stops, _clip in (("q_tonemap_bytes", 0.0, False), ("q_tonemap_clip", 0.0, True), ("q_tonemap_stops", 1.5, False)):
    _query(_name, _tone_sql(_stops, _clip, f" SELECT image_id, {CHECK} FROM q GROUP BY image_id"))(lambda spark, d, s=_stops, c=_clip: _checked(colour.tone_map(light_pixels(table(spark, d, "embeddings")), s, c)))


@_query("q_float_from_raster", _matrix_sql(colour.P3_TO_SRGB) + " SELECT image_id, round(sum(lr), 4) AS sum_r, round(sum(lg), 4) AS sum_g, round(sum(lb), 4) AS sum_b, round(sum((a / 255::DOUBLE)::FLOAT::DOUBLE), 4) AS sum_a FROM lin GROUP BY image_id")
def q_float_from_raster(spark: SparkSession, d: str) -> DataFrame:
    light = colour.to_light(text_pixels(_docs(spark, d), alpha=True))
    return light.groupBy("image_id").agg(*(F.round(F.sum(F.col(c).cast("double")), 4).alias(f"sum_{c}") for c in "rgba"))


# ---------------------------------------------------------------- palettes

_PALETTE = """, c AS (SELECT image_id, CASE WHEN a < 128 THEN -1 ELSE r * 65536 + g * 256 + b END AS rgb, min(y * 16 + x) AS first FROM pf GROUP BY ALL),
pal AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY rgb = -1, first) - 1)::INT AS index, CASE WHEN rgb = -1 THEN 0 ELSE rgb END AS rgb, CASE WHEN rgb = -1 THEN 0 ELSE 255 END AS alpha FROM c)"""


@_query("q_exact_palette", _PALETTE + " SELECT image_id, index, rgb, alpha FROM pal")
def q_exact_palette(spark: SparkSession, d: str) -> DataFrame:
    return palette.exact_palette(text_pixels(_docs(spark, d), alpha=True, few=True))


@_query("q_indexed", _PALETTE + f", i AS (SELECT p.image_id, p.y, p.x, l.index FROM pf p JOIN pal l ON p.image_id = l.image_id AND CASE WHEN p.a < 128 THEN l.alpha = 0 ELSE l.alpha = 255 AND l.rgb = p.r * 65536 + p.g * 256 + p.b END), q AS (SELECT i.image_id, 16 AS width, 12 AS height, y, x, (rgb >> 16) AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b, alpha AS a FROM i JOIN pal USING (image_id, index)) SELECT image_id, {CHECK} FROM q GROUP BY image_id")
def q_indexed(spark: SparkSession, d: str) -> DataFrame:
    pixels = text_pixels(_docs(spark, d), alpha=True, few=True)
    entries = palette.exact_palette(pixels)
    back = palette.indexed_to_pixels(palette.indexed(pixels, entries), entries)
    return _checked(back.withColumns({"width": F.lit(16), "height": F.lit(12)}))


@_query("q_hist15", " SELECT image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bin, count(*) AS n, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b FROM pa WHERE a >= 128 GROUP BY ALL")
def q_hist15(spark: SparkSession, d: str) -> DataFrame:
    return palette.histogram15(text_pixels(_docs(spark, d), alpha=True))


GIVEN = ((0, 0, 0), (255, 255, 255), (110, 104, 101), (32, 116, 97), (195, 169, 105), (101, 110, 32), (46, 10, 84), (128, 64, 200))


@_query("q_nearest_palette", f", e AS (SELECT unnest(range({len(GIVEN)})) AS i, unnest({[c[0] for c in GIVEN]}) AS er, unnest({[c[1] for c in GIVEN]}) AS eg, unnest({[c[2] for c in GIVEN]}) AS eb), s AS (SELECT image_id, y, x, arg_min(i, ((r - er) * (r - er) * 3 + (g - eg) * (g - eg) * 6 + (b - eb) * (b - eb)) * 100 + i) AS i FROM px, e GROUP BY ALL) SELECT image_id, i::INT AS index, count(*) AS n FROM s GROUP BY ALL")
def q_nearest_palette(spark: SparkSession, d: str) -> DataFrame:
    return palette.nearest(text_pixels(_docs(spark, d)), GIVEN).groupBy("image_id", "index").agg(F.count("*").alias("n"))


@_query("q_rle_runs", ", m AS (SELECT image_id, y, x, r, g, b, a, CASE WHEN lag(r) OVER w = r AND lag(g) OVER w = g AND lag(b) OVER w = b AND lag(a) OVER w = a THEN 0 ELSE 1 END AS new FROM pf WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), n AS (SELECT image_id, y, sum(new) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM m), l AS (SELECT image_id, y, run, count(*) AS length FROM n GROUP BY ALL) SELECT image_id, count(*) AS n_runs, max(length) AS longest FROM l GROUP BY image_id")
def q_rle_runs(spark: SparkSession, d: str) -> DataFrame:
    return palette.runs(text_pixels(_docs(spark, d), alpha=True, few=True)).groupBy("image_id").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"))


for _name, _along, _other in (("q_png_sub_filter", "x", "y"), ("q_png_up_filter", "y", "x")):
    _cols = ", ".join(f"(({c} - coalesce(lag({c}) OVER w, 0)) % 256 + 256) % 256 AS {c}" for c in "rgba")
    _query(_name, f", q AS (SELECT image_id, width, height, y, x, {_cols} FROM pa WINDOW w AS (PARTITION BY image_id, {_other} ORDER BY {_along})) SELECT image_id, {CHECK} FROM q GROUP BY image_id")(lambda spark, d, along=_along: _checked(palette.differences(text_pixels(_docs(spark, d), alpha=True), along)))


# ---------------------------------------------------------------- names and times


@_query("q_output_name", r"""SELECT page_id, CASE WHEN regexp_matches(stem, '^\.*$') THEN 'image' ELSE stem END || '.png' AS name FROM (
    SELECT page_id, regexp_replace(t, '^(.+)\.[^.]*$', '\1', 's') AS stem FROM (SELECT page_id, trim(regexp_replace(url, '[\\/]', '', 'g')) AS t FROM pages))""", plain=True)
def q_output_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", naming.output_name(F.col("url"), "png").alias("name"))


_EXT = ("png", "JPG", "tif", "heif", "ppm", "xyz", "cr2", "ff", "html", "dib")


@_query("q_format_for_extension", f"SELECT p_partkey, CASE lower(e) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' WHEN 'heif' THEN 'heic' WHEN 'ppm' THEN 'pnm' WHEN 'cr2' THEN 'raw' WHEN 'ff' THEN 'farbfeld' WHEN 'dib' THEN 'bmp' END AS format FROM (SELECT p_partkey, ({list(_EXT)})[(p_partkey % 10 + 1)::INT] AS e FROM part)", plain=True)
def q_format_for_extension(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(".", "p_name", F.element_at(F.array(*map(F.lit, _EXT)), (F.col("p_partkey") % 10 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", naming.format_for_extension(name).alias("format"))


@_query("q_svg_size", """SELECT p_partkey, round(width, 6) AS width, round(height, 6) AS height, declared FROM (SELECT p_partkey, CASE k WHEN 0 THEN p_size WHEN 1 THEN p_size * 96 / 25.4::DOUBLE WHEN 2 THEN 2 * p_size ELSE 300 END::DOUBLE AS width,
    CASE k WHEN 0 THEN 2 * p_size WHEN 1 THEN p_size * 96 / 25.4::DOUBLE * 3 / 2 WHEN 2 THEN 3 * p_size ELSE 150 END::DOUBLE AS height, k < 3 AS declared FROM (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part))""", plain=True)
def q_svg_size(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit('<svg width="'), s, F.lit("px\" height='"), (F.col("p_size") * 2).cast("string"), F.lit("'>"))).when(k == 1, F.concat(F.lit('<svg viewBox="0 0 2 3" width="'), s, F.lit('mm">')))
    text = text.when(k == 2, F.concat(F.lit('<?xml?><svg viewBox="0,0,'), (F.col("p_size") * 2).cast("string"), F.lit(" "), (F.col("p_size") * 3).cast("string"), F.lit('">'))).otherwise(F.lit('<svg width="50%">'))
    out = table(spark, d, "part").select("p_partkey", naming.svg_size(text).alias("s")).select("p_partkey", "s.*")
    return out.withColumns({c: F.round(c, 6) for c in ("width", "height")})


@_query("q_gif_delay", "SELECT event_id, least(greatest(floor(abs(value) * 100 / 10 + 0.5), 0), 65535)::INT AS hundredths FROM events", plain=True)
def q_gif_delay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", naming.gif_delay(F.abs("value") * 100).alias("hundredths"))


@_query("q_apng_delay", "SELECT event_id, CASE WHEN n1 <= 65535 THEN n1 WHEN n2 <= 65535 THEN n2 ELSE n3 END AS num, CASE WHEN n1 <= 65535 THEN 1000 WHEN n2 <= 65535 THEN 100 ELSE 10 END AS den FROM (SELECT event_id, floor(ms * 1000 / 1000::DOUBLE + 0.5)::INT AS n1, floor(ms * 100 / 1000::DOUBLE + 0.5)::INT AS n2, floor(ms * 10 / 1000::DOUBLE + 0.5)::INT AS n3 FROM (SELECT event_id, (event_id * 7919 % 1000000)::DOUBLE AS ms FROM events))", plain=True)
def q_apng_delay(spark: SparkSession, d: str) -> DataFrame:
    ms = (F.col("event_id") * 7919 % 1000000).cast("double")
    return table(spark, d, "events").select("event_id", naming.apng_delay(ms).alias("t")).select("event_id", "t.*")


@_query("q_loop_count", "SELECT p_partkey, CASE WHEN k = 3 THEN 0 WHEN k <= 0 THEN 1 ELSE k + 1 END::INT AS plays FROM (SELECT p_partkey, p_partkey % 5 - 1 AS k FROM part)", plain=True)
def q_loop_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5 - 1
    return table(spark, d, "part").select("p_partkey", naming.plays_from_repeats(F.when(k == 3, F.lit(float("inf"))).otherwise(k.cast("double"))).alias("plays"))


# ---------------------------------------------------------------- codecs


def _round_trip(fmt: str, source: str) -> None:
    """Encoded, recognised, decoded and unpacked; the checksum is that of the source."""
    variant = {"px": {}, "pa": {"alpha": True}, "pf": {"alpha": True, "few": True}}[source]

    def f(spark: SparkSession, d: str) -> DataFrame:
        written = sources.encode(synth_images(_docs(spark, d), **variant), fmt)
        read = sources.decode(written, key="image_id").where(F.col("format") == fmt)
        return _checked(sources.to_pixels(read))

    _query(f"q_roundtrip_{fmt}", f" SELECT image_id, {CHECK} FROM {source} GROUP BY image_id")(f)


for _fmt, _source in (("png", "pa"), ("apng", "pa"), ("qoi", "pa"), ("bmp", "pa"), ("tga", "pa"), ("farbfeld", "pa"), ("tiff", "pa"), ("ras", "pa"), ("pnm", "pa"), ("pcx", "px")):
    _round_trip(_fmt, _source)


def _hard(name: str, fmt: str) -> None:
    """Formats with one clear entry: the few colours with alpha hardened to clear or opaque come back as they were."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        pixels = text_pixels(_docs(spark, d), few=True, alpha=True)
        clear = F.col("a") < 128
        hard = pixels.withColumns({c: F.when(clear, 0).otherwise(F.col(c)) for c in "rgb"} | {"a": F.when(clear, 0).otherwise(255)})
        return _checked(sources.to_pixels(sources.decode(sources.encode(sources.from_pixels(hard), fmt), key="image_id")))

    _query(name, f", q AS (SELECT image_id, width, height, y, x, {', '.join(f'CASE WHEN a < 128 THEN 0 ELSE {c} END AS {c}' for c in 'rgb')}, CASE WHEN a < 128 THEN 0 ELSE 255 END AS a FROM pf) SELECT image_id, {CHECK} FROM q GROUP BY image_id")(f)


_hard("q_roundtrip_gif", "gif")
_hard("q_roundtrip_xpm", "xpm")


@_query("q_roundtrip_xbm", f", q AS (SELECT image_id, width, height, y, x, 0 AS r, 0 AS g, 0 AS b, CASE WHEN a >= 128 AND r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE < 128 THEN 255 ELSE 0 END AS a FROM pa) SELECT image_id, {CHECK} FROM q GROUP BY image_id")
def q_roundtrip_xbm(spark: SparkSession, d: str) -> DataFrame:
    return _checked(sources.to_pixels(sources.decode(sources.encode(synth_images(_docs(spark, d), alpha=True), "xbm"), key="image_id")))


@_query("q_pack_unpack", f" SELECT image_id, {CHECK} FROM pa GROUP BY image_id")
def q_pack_unpack(spark: SparkSession, d: str) -> DataFrame:
    return _checked(sources.to_pixels(sources.from_pixels(text_pixels(_docs(spark, d), alpha=True))))


def _bytes_query(name: str, fmt: str, source: str, head: str, pixel: str, order: str = "p") -> None:
    """The MD5 of what a plain encoder writes; ``head`` and ``pixel`` are hex in SQL."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        made = sources.encode(synth_images(_docs(spark, d), alpha=source == "pa"), fmt)
        return made.select("image_id", F.md5("content").alias("md5"), F.octet_length("content").alias("n_bytes"))

    body = f"string_agg({pixel}, '' ORDER BY {order})"
    _query(name, f", h AS (SELECT image_id, {head} || {body} AS hx FROM (SELECT *, y * 16 + x AS p FROM {source}) GROUP BY image_id) SELECT image_id, md5(unhex(hx)) AS md5, (length(hx) // 2)::INT AS n_bytes FROM h")(f)


_HEX = "printf('%02x', {})"
_bytes_query("q_pnm_md5", "pnm", "px", f"'{b'P6' .hex()}0a{b'16 12'.hex()}0a{b'255'.hex()}0a'", " || ".join(_HEX.format(c) for c in "rgb"))
_bytes_query("q_farbfeld_md5", "farbfeld", "px", f"'{b'farbfeld'.hex()}000000100000000c'", " || ".join(f"{_HEX.format(c)} || {_HEX.format(c)}" for c in "rgba"))
_bytes_query("q_ras_md5", "ras", "px", "'59a66a95000000100000000c000000180000024000000001" + "00000000" * 2 + "'", " || ".join(_HEX.format(c) for c in "bgr"))
_bytes_query("q_bmp_md5", "bmp", "px", "'424d" + (54 + 576).to_bytes(4, "little").hex() + "00000000360000002800000010000000" + "0c00000001001800000000004002000013" + "0b0000130b0000" + "0000000000000000'", " || ".join(_HEX.format(c) for c in "bgr"), "11 - y, x")


@_query("q_sniff", "SELECT fmt, fmt AS found, n FROM (SELECT unnest(['apng', 'bmp', 'exr', 'farbfeld', 'gif', 'hdr', 'icns', 'ico', 'jpeg', 'pcx', 'png', 'pnm', 'qoi', 'ras', 'tga', 'tiff', 'xbm', 'xpm']) AS fmt), (SELECT count(*) AS n FROM documents WHERE octet_length(encode(text)) > 0)", plain=True)
def q_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Every format that is written is recognised by the column expression."""
    pictures = synth_images(_docs(spark, d))
    out = None
    for fmt in default_registry().writable():
        part = sources.encode(pictures, fmt).select(F.lit(fmt).alias("fmt"), detect.format_of(F.col("content")).alias("found"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("fmt", "found").agg(F.count("*").alias("n"))


@_query("q_measure", "SELECT fmt, 16::BIGINT AS width, 12::BIGINT AS height, n FROM (SELECT unnest(['png', 'gif', 'pcx']) AS fmt), (SELECT count(*) AS n FROM documents WHERE octet_length(encode(text)) > 0)", plain=True)
def q_measure(spark: SparkSession, d: str) -> DataFrame:
    pictures = synth_images(_docs(spark, d), few=True)
    out = None
    for fmt in ("png", "gif", "pcx"):
        part = sources.encode(pictures, fmt).select(F.lit(fmt).alias("fmt"), detect.measure(F.col("content"), detect.format_of(F.col("content"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.select("fmt", "s.*").groupBy("fmt", "width", "height").agg(F.count("*").alias("n"))


@_query("q_convert_report", "SELECT 'png' AS source_format, 'qoi' AS target_format, d.lang, count(*) AS n_files, count(*) AS n_ok, 8 * 6 * count(*) AS pixels FROM documents d WHERE octet_length(encode(text)) > 0 GROUP BY d.lang", plain=True)
def q_convert_report(spark: SparkSession, d: str) -> DataFrame:
    """PNG to QOI at half the size, and what the reports say of it by language."""
    made = convert(sources.encode(synth_images(_docs(spark, d), alpha=True), "png"), Settings(to="qoi", longest_side=8), key="image_id")
    joined = made.join(_docs(spark, d).select(F.col("doc_id").alias("image_id"), "lang"), "image_id")
    return joined.groupBy(F.col("report.source_format").alias("source_format"), F.col("report.target_format").alias("target_format"), "lang").agg(F.count("*").alias("n_files"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum((F.col("report.target_width") * F.col("report.target_height")).cast("long")).alias("pixels"))


@_query("q_readable_not_writable", "SELECT unnest(['dds', 'heic', 'psd', 'raw']) AS format", plain=True)
def q_readable_not_writable(spark: SparkSession, d: str) -> DataFrame:
    r = default_registry()
    rows = [(f,) for f in r.readable()], [(f,) for f in r.writable()]
    readable, writable = (spark.createDataFrame(x, "format string") for x in rows)
    return readable.join(writable, "format", "left_anti")


@_query("q_codec_ladder", "SELECT 'apng' AS format, unnest(['apng-pure', 'apng-fallback']) AS id, unnest([1, 2]) AS rung UNION ALL SELECT f, f || '-pure', 1 FROM (SELECT unnest(['bmp', 'dds', 'exr', 'farbfeld', 'gif', 'hdr', 'icns', 'ico', 'jpeg', 'pcx', 'png', 'pnm', 'psd', 'qoi', 'ras', 'tga', 'tiff', 'xbm', 'xpm']) AS f) UNION ALL VALUES ('raw', 'raw-preview', 1), ('tiff', 'tiff-preview', 2), ('gif', 'gif-fallback', 2), ('heic', 'heic-jpeg', 1)", plain=True)
def q_codec_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Decoders by format in the order in which they are tried."""
    from pyspark.sql import Window

    rows = [(x.format, x.id, x.priority, i) for i, x in enumerate(default_registry().decoders.values())]
    table_of = spark.createDataFrame(rows, "format string, id string, priority int, at int")
    return table_of.select("format", "id", F.row_number().over(Window.partitionBy("format").orderBy("priority", "at")).alias("rung"))


# ---------------------------------------------------------------- animations

_OVER = "CASE WHEN blend = 0 OR va = 255 THEN v{c} WHEN va = 0 THEN c{c} ELSE floor((v{c} * (va / 255::DOUBLE) + c{c} * (ca / 255::DOUBLE) * (1 - va / 255::DOUBLE)) / (va / 255::DOUBLE + ca / 255::DOUBLE * (1 - va / 255::DOUBLE)) + 0.5::DOUBLE)::INT END AS n{c}"
_OVER_A = "CASE WHEN blend = 0 OR va = 255 THEN va WHEN va = 0 THEN ca ELSE floor((va / 255::DOUBLE + ca / 255::DOUBLE * (1 - va / 255::DOUBLE)) * 255 + 0.5::DOUBLE)::INT END AS na"
_AFTER = ", ".join(f"CASE WHEN NOT hit OR dispose = 0 THEN n{c} WHEN dispose = 1 THEN 0 ELSE c{c} END AS c{c}" for c in "rgba")
_SHOWN = ", ".join(f"n{c} AS s{c}" for c in "rgba")
_VALUE = ", ".join(f"CASE WHEN hit THEN s[4 * ((y - y0) * 4 + x - x0) + {k} + 1]::INT END AS v{c}" for k, c in enumerate("rgba"))


@_query("q_anim_compose", f"""WITH RECURSIVE heads AS (SELECT *, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM conversations WHERE octet_length(encode(text)) > 0),
    f AS MATERIALIZED (SELECT conv_id AS image_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
    list_transform(range(64), lambda j: list_sum(list_transform(range(0, (n + 63) // 64), lambda i: ('0x' || substr(h, 2 * ((j + 64 * i) % n) + 1, 2))::INT)) & 255) AS s, turn % 5 AS x0, turn * 3 % 5 AS y0, turn % 3 AS dispose, turn % 2 AS blend FROM heads),
    r AS (SELECT image_id, y, x, 0::BIGINT AS k, 0 AS cr, 0 AS cg, 0 AS cb, 0 AS ca, 0 AS sr, 0 AS sg, 0 AS sb, 0 AS sa FROM (SELECT DISTINCT image_id FROM f), (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)
    UNION ALL SELECT image_id, y, x, k, {_AFTER}, {_SHOWN} FROM (SELECT *, {', '.join(f'CASE WHEN hit THEN d{c} ELSE c{c} END AS n{c}' for c in 'rgba')} FROM (
      SELECT *, {', '.join((_OVER if c != 'a' else _OVER_A).format(c=c).replace(' AS n', ' AS d') for c in 'rgba')} FROM (SELECT *, {_VALUE} FROM (
        SELECT r.image_id, y, x, f.k, cr, cg, cb, ca, s, x0, y0, dispose, blend, x BETWEEN x0 AND x0 + 3 AND y BETWEEN y0 AND y0 + 3 AS hit FROM r JOIN f ON f.image_id = r.image_id AND f.k = r.k + 1)))))
    SELECT image_id, (k - 1)::INT AS frame, sum(((y * 8 + x + 1)::BIGINT * (sr::BIGINT + 256 * sg::BIGINT + 65536 * sb::BIGINT + 16777216 * sa::BIGINT)) % 1000003)::BIGINT AS checksum FROM r WHERE k > 0 GROUP BY ALL""", plain=True)
def q_anim_compose(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as animations: each turn a 4 x 4 patch on an 8 x 8 canvas, with disposal and blending by its number."""
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").where(F.octet_length("text") > 0)
    turns = turns.withColumn("frame", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int"))
    frames = turns.select(F.col("conv_id").alias("image_id"), "frame", (F.col("turn") % 3).cast("int").alias("dispose"), (F.col("turn") % 2).cast("int").alias("blend"))
    raw = folded(turns.select(F.col("conv_id").alias("image_id"), "frame", "turn", "text"), 64).select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    channel = lambda k: F.element_at("samples", 4 * F.col("p") + k + 1)
    patches = raw.select("image_id", "frame", (F.col("turn") * 3 % 5 + F.floor(F.col("p") / 4)).cast("int").alias("y"), (F.col("turn") % 5 + F.col("p") % 4).cast("int").alias("x"), *(channel(k).alias(c) for k, c in enumerate("rgba")))
    out = animation.compose(frames, patches, 8, 8).withColumn("width", F.lit(8))
    return out.groupBy("image_id", "frame").agg(_checksum())


# ---------------------------------------------------------------- light through files


def _light_trip(name: str, fmt: str, bits: int) -> None:
    """Scene light written and read: no sample is off by more than the format's mantissa, measured on the pixel's largest."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        pictures = light_images(table(spark, d, "embeddings"))
        back = sources.decode(sources.encode(pictures, fmt), key="image_id").select("image_id", F.col("image").alias("back"))
        both = pictures.join(back, "image_id").select("image_id", F.col("image.data").alias("a"), F.col("back.data").alias("b"))
        return both.mapInArrow(sources.largest_error, "image_id bigint, error double").select("image_id", (F.col("error") <= 2.0**-bits).alias("within"))

    _query(name, "SELECT vec_id AS image_id, TRUE AS within FROM embeddings", plain=True)(f)


_light_trip("q_roundtrip_exr", "exr", 10)
_light_trip("q_roundtrip_hdr_error", "hdr", 7)


@_query("q_predictor2", ", q AS (SELECT image_id, width, height, y, x, " + ", ".join(f"(sum(d{c}) OVER w) % 256 AS {c}" for c in "rgba") + " FROM (SELECT *, " + ", ".join(f"(({c} - coalesce(lag({c}) OVER v, 0)) % 256 + 256) % 256 AS d{c}" for c in "rgba") + f" FROM pa WINDOW v AS (PARTITION BY image_id, y ORDER BY x)) WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) SELECT image_id, {CHECK} FROM q GROUP BY image_id")
def q_predictor2(spark: SparkSession, d: str) -> DataFrame:
    """Differences along rows and their running sums: what TIFF's predictor undoes."""
    return _checked(palette.running_sums(palette.differences(text_pixels(_docs(spark, d), alpha=True), "x"), "x"))


@_query("q_convert_errors", "SELECT code, count(*) AS n_files FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'input/empty' WHEN 1 THEN 'input/unknown-format' WHEN 2 THEN 'decode/failed' ELSE 'ok' END AS code FROM documents WHERE octet_length(encode(text)) > 0) GROUP BY code", plain=True)
def q_convert_errors(spark: SparkSession, d: str) -> DataFrame:
    """Files that are empty, no image, cut off, or well: each is a row with its code."""
    made = sources.encode(synth_images(_docs(spark, d)), "png")
    k = F.pmod("image_id", F.lit(4))
    content = F.when(k == 0, F.lit(b"")).when(k == 1, F.lit(b"no image at all")).when(k == 2, F.substring("content", 1, 60)).otherwise(F.col("content"))
    out = convert(made.select("image_id", content.alias("content")), Settings(to="bmp"), key="image_id")
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n_files"))


from . import built as _built  # noqa: E402, F401  its queries register themselves
