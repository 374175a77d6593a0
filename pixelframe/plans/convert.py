"""Conversion of a DataFrame of files: content in, content and a report out.

What a file is and, where its header says so, how large it is, are column expressions; what is refused by them never
reaches a worker. The rest runs in Arrow batches, one file after another. A file that fails is a row with an
error code, never a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ImageError
from ..formats import BY_ID, WIDE_GAMUT
from ..functions import detect
from ..functions import exif as exif_of
from ..raster import Decoded, Frame, Raster, fit_longest_side, flatten, resize, to_colour_space, tone_map, with_alpha
from ..registry import Options, Registry, default_registry
from ..sources.images import in_pieces

MOST_PIXELS = 80_000_000
REPORT = (
    "source_format string, target_format string, source_bytes bigint, target_bytes bigint, width int, height int, target_width int, target_height int, decoder string, "
    "decode_path string, encoder string, had_alpha boolean, flattened boolean, resized boolean, colour_space string, narrowed boolean, tone_mapped boolean, white double, frames int, "
    "frames_kept int, loop_count int, had_exif boolean, exif_kept boolean, had_icc boolean, icc_kept boolean, had_gain_map boolean, gain_map_kept boolean, dropped_plane boolean, frames_truncated int, duration_ms double"
)
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_REPORT_TYPE = pa.struct([(x.split()[0], _KINDS[x.split()[1]]) for x in REPORT.split(", ")])


@dataclass(frozen=True)
class Settings:
    """How to convert: the target, and what to do on the way."""

    to: str = "png"
    metadata: str = "strip"
    colour: str = "auto"
    longest_side: float | None = None
    most_pixels: int = MOST_PIXELS
    frames: str = "keep"
    stops: float = 0.0
    #: Frames after so many are left out, and the report says how many.
    most_frames: int | None = None
    options: Options = Options()


def convert_bytes(data: bytes, settings: Settings, registry: Registry, source: str | None = None) -> tuple[bytes, dict]:
    """One file: (content, report). Raises an :class:`ImageError` whose code says what is wrong. ``source``: the format, where it is known."""
    began = time.perf_counter()
    source = source or detect.required(data)
    found, decoder = registry.decode(data, source, settings.most_pixels)
    truncated = max(0, len(found.frames) - settings.most_frames) if settings.most_frames is not None else 0
    if truncated:
        found.frames = found.frames[: settings.most_frames]
    ladder = registry.encoders_for(settings.to)
    target = BY_ID[settings.to]
    report: dict = {"source_format": source, "target_format": settings.to, "source_bytes": len(data), "width": found.image.width, "height": found.image.height}
    report |= {"decoder": decoder.id, "decode_path": decoder.path, "had_alpha": found.image.has_alpha, "frames": max(1, len(found.frames)), "loop_count": found.loop_count}
    animates = bool(found.frames) and settings.frames == "keep" and any(e.animates for e in ladder)
    narrow = settings.colour == "srgb" or (settings.colour == "auto" and settings.to not in WIDE_GAMUT)
    flags = {"flattened": False, "resized": False, "narrowed": False}

    def corrected(image: Raster) -> Raster:
        if settings.longest_side is not None:
            width, height = fit_longest_side(image.width, image.height, settings.longest_side)
            flags["resized"] |= (width, height) != (image.width, image.height)
            image = resize(image, width, height)
        if image.has_alpha:
            image = with_alpha(image.data, image.colour_space)
        if image.has_alpha and not target.alpha and not image.is_light:
            image = flatten(image, settings.options.background)
            flags["flattened"] = True
        if narrow and image.colour_space != "srgb":
            image = to_colour_space(image, "srgb")
            flags["narrowed"] = True
        return image

    image, white = found.image, None
    if image.is_light and not any(e.floats for e in ladder):
        # Light becomes bytes at full size; the bytes are resized.
        image, white = tone_map(image, settings.stops)
    image = corrected(image)
    frames = [Frame(corrected(f.image), f.delay_ms) for f in found.frames] if animates else []
    keep = settings.metadata == "preserve"
    payload = found.exif or exif_of.payload_of(data, source)
    icc = found.icc if found.icc and keep and not flags["narrowed"] and image.colour_space == found.image.colour_space else None
    options = replace(settings.options, icc=icc, exif=exif_of.upright(payload) if payload and keep else None)
    content, encoder = registry.encode(Decoded(image, frames, found.loop_count), settings.to, options)
    report |= flags | {"target_bytes": len(content), "target_width": image.width, "target_height": image.height, "encoder": encoder.id, "colour_space": image.colour_space}
    report |= {"tone_mapped": white is not None, "white": white, "frames_kept": max(1, len(frames) if encoder.animates else 1), "had_exif": payload is not None}
    report |= {"exif_kept": options.exif is not None and settings.to in ("png", "tiff", "jpeg"), "had_icc": found.icc is not None, "icc_kept": icc is not None and settings.to in ("png", "apng", "tiff", "jpeg")}
    # No format that is written here carries a gain map; where the colours were moved it would be wrong anyway.
    report |= {"had_gain_map": found.gain_map is not None, "gain_map_kept": False, "dropped_plane": found.dropped, "frames_truncated": truncated}
    return content, report | {"duration_ms": (time.perf_counter() - began) * 1000}


def convert(files: DataFrame, settings: Settings | None = None, registry: Registry | None = None, content: str = "content", key: str = "path") -> DataFrame:
    """``files`` (key, content) as key, ok, content, mime, extension, error_code, error_message and report.

    Files that are empty, unknown or larger than allowed by their headers are refused before they are sent to Python.
    """
    settings, registry = settings or Settings(), registry or default_registry()
    if settings.to not in BY_ID:
        raise ValueError(f"{settings.to} is no format")
    target = BY_ID[settings.to]
    body = F.col(content)
    seen = files.select(F.col(key).alias("key"), body.alias("content"), detect.format_of(body).alias("format"))
    size = detect.measure(F.col("content"), F.col("format"))
    refused = (
        F.when(F.col("content").isNull() | (F.octet_length("content") == 0), F.lit("input/empty"))
        .when(F.col("format").isNull(), F.lit("input/unknown-format"))
        .when(size["width"] * size["height"] > settings.most_pixels, F.lit("input/too-large"))
    )
    seen = seen.withColumn("refused", refused).select("key", F.when(F.col("refused").isNull(), F.col("content")).alias("content"), "refused", "format")
    key_type = files.schema[key].dataType.simpleString()

    def one(data: bytes | None, code: str | None, source: str | None) -> tuple:
        if code is not None:
            return False, None, None, None, code, None, None
        try:
            made, report = convert_bytes(data, settings, registry, source)
            return True, made, target.mime, target.extension, None, None, report
        except ImageError as e:
            return False, None, None, None, e.code, str(e), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_pieces(batch, lambda i, batch=batch: one(*(batch.column(k)[i].as_py() for k in (1, 2, 3))), _OUT, lambda r: len(r[1] or b""))

    out = seen.mapInArrow(run, f"key {key_type}, ok boolean, content binary, mime string, extension string, error_code string, error_message string, report struct<{REPORT.replace(' ', ':').replace(',:', ',')}>")
    return out.withColumnRenamed("key", key)


_OUT = [("ok", pa.bool_()), ("content", pa.binary()), ("mime", pa.string()), ("extension", pa.string()), ("error_code", pa.string()), ("error_message", pa.string()), ("report", _REPORT_TYPE)]


def summary(converted: DataFrame) -> DataFrame:
    """How many files of each source format went well, or why not."""
    return converted.groupBy(F.col("report.source_format").alias("source_format"), "ok", "error_code").agg(F.count("*").alias("n_files"), F.sum("report.source_bytes").alias("source_bytes"), F.sum("report.target_bytes").alias("target_bytes"))
