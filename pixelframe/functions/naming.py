"""Names, lengths and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats import FORMATS


def output_name(name: Column, extension: str | Column) -> Column:
    """``name`` without slashes and with another extension; a leading dot is no extension, nothing but dots is ``image``."""
    trimmed = F.regexp_replace(F.regexp_replace(name, r"[\\/]", ""), r"^\s+|\s+$", "")
    stem = F.regexp_replace(trimmed, r"(?s)^(.+)\.[^.]*$", "$1")
    return F.concat(F.when(stem.rlike(r"^\.*$"), F.lit("image")).otherwise(stem), F.lit("."), extension if isinstance(extension, Column) else F.lit(extension))


def format_for_extension(name: Column) -> Column:
    """The format of a file name's extension; null if there is none that is known."""
    table = F.create_map(*[F.lit(x) for e, f in _by_extension().items() for x in (e, f)])
    return F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def format_for_mime(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for f in FORMATS for m in f.mimes for x in (m, f.id)])
    return F.try_element_at(table, F.trim(F.lower(F.substring_index(mime, ";", 1))))


def _by_extension() -> dict[str, str]:
    out: dict[str, str] = {}
    for f in FORMATS:
        for e in f.extensions:
            out.setdefault(e, f.id)
    return out


#: CSS units in pixels.
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}


def svg_length(value: Column) -> Column:
    """A CSS length in pixels; null for percentages, unknown units and what is not above zero."""
    found = r"^\s*([+-]?[0-9]*\.?[0-9]+)\s*([a-zA-Z%]*)\s*$"
    factor = F.try_element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)]), F.lower(F.regexp_extract(value, found, 2)))
    number = F.when(value.rlike(found), F.regexp_extract(value, found, 1).try_cast("double"))
    return F.when(number > 0, number * factor)


def svg_size(source: Column) -> Column:
    """(width, height, declared) of an SVG text: stated, or by the view box, or 300 x 150."""
    tag = F.regexp_extract(source, r"(?is)<svg\b[^>]*>", 0)
    attribute = lambda n: F.nullif(F.concat(F.regexp_extract(tag, rf"(?is)\s{n}\s*=\s*\"([^\"]*)\"", 1), F.regexp_extract(tag, rf"(?is)\s{n}\s*=\s*'([^']*)'", 1)), F.lit(""))
    w, h = svg_length(attribute("width")), svg_length(attribute("height"))
    box = F.split(F.trim(attribute("viewBox")), r"[\s,]+")
    bw, bh = F.try_element_at(box, F.lit(3)).try_cast("double"), F.try_element_at(box, F.lit(4)).try_cast("double")
    boxed = (F.size(box) == 4) & (bw > 0) & (bh > 0)
    sized = lambda a, b, d: F.struct(a.alias("width"), b.alias("height"), F.lit(d).alias("declared"))
    return (
        F.when(w.isNotNull() & h.isNotNull(), sized(w, h, True))
        .when(boxed & w.isNotNull(), sized(w, w * bh / bw, True))
        .when(boxed & h.isNotNull(), sized(h * bw / bh, h, True))
        .when(boxed, sized(bw, bh, True))
        .when(w.isNotNull(), sized(w, w, True))
        .when(h.isNotNull(), sized(h, h, True))
        .otherwise(sized(F.lit(300.0), F.lit(150.0), False))
    )


# ---------------------------------------------------------------- times


def gif_delay(ms: Column) -> Column:
    """Milliseconds as hundredths of a second, half up, within 16 bits."""
    return F.least(F.greatest(F.floor(ms / 10 + F.lit(0.5)), F.lit(0)), F.lit(65535)).cast("int")


def gif_delay_read(hundredths: Column) -> Column:
    """What a stated delay means: one hundredth and less is a tenth of a second."""
    return F.when(hundredths <= 1, F.lit(100.0)).otherwise(hundredths * F.lit(10.0))


def apng_delay(ms: Column) -> Column:
    """(numerator, denominator): the finest of 1000, 100, 10 and 1 whose numerator fits into 16 bits."""
    num = lambda d: F.floor(ms * d / F.lit(1000.0) + F.lit(0.5)).cast("int")
    pair = lambda n, d: F.struct(n.alias("num"), F.lit(d).alias("den"))
    return F.when(num(1000) <= 65535, pair(num(1000), 1000)).when(num(100) <= 65535, pair(num(100), 100)).when(num(10) <= 65535, pair(num(10), 10)).otherwise(pair(F.least(num(1), F.lit(65535)), 1))


def normalised_delay(ms: Column) -> Column:
    """Absent, negative and very short delays are 100 ms."""
    return F.when(ms.isNull() | (ms <= 10), F.lit(100.0)).otherwise(ms)


def plays_from_repeats(repeats: Column) -> Column:
    """Repetitions after the first play as a number of plays: endless is 0."""
    return F.when(repeats == float("inf"), F.lit(0)).when(repeats <= 0, F.lit(1)).otherwise(F.floor(repeats) + 1).cast("int")


def webp_duration(ms: Column) -> Column:
    """Milliseconds, half up, within 24 bits; absent is 0."""
    return F.least(F.greatest(F.floor(F.coalesce(ms, F.lit(0.0)) + F.lit(0.5)), F.lit(0)), F.lit((1 << 24) - 1)).cast("int")
