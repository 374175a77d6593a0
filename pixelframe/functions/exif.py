"""EXIF payloads: summary, upright rewriting, and where formats keep them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import jpeg, png
from ..codecs.tiff import Directory, directories
from ..errors import ImageError


@dataclass(frozen=True)
class Summary:
    orientation: int | None = None
    has_location: bool = False
    captured_at: str | None = None
    camera_make: str | None = None
    camera_model: str | None = None
    software: str | None = None
    has_serial_number: bool = False
    tag_count: int = 0

    def row(self) -> dict:
        return asdict(self)


#: Tags.
_ORIENTATION, _EXIF, _GPS, _PROFILE = 0x0112, 0x8769, 0x8825, 0x8773
_TEXTS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0131: "software"}
_TIMES, _SERIALS = (0x9003, 0x9004, 0x0132), (0xA431, 0xC62F, 0xA435)


def payload_of(data: bytes, fmt: str) -> bytes | None:
    """The TIFF-like payload in a file of ``fmt``; None if there is none."""
    try:
        if fmt == "jpeg":
            found = jpeg.exif(data)
        elif fmt in ("png", "apng"):
            found = next((b for k, b in png.chunks(data) if k == b"eXIf"), None)
        elif fmt == "webp":
            found = next((b.removeprefix(b"Exif\0\0") for k, b in riff_chunks(data) if k == b"EXIF"), None)
        elif fmt == "tiff":
            found = data
        else:
            return None
    except ImageError:
        return None
    return found if found and found[:4] in (b"II*\0", b"MM\0*") else None


def riff_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(type, body) of the chunks of a RIFF file; a chunk of odd size has a byte after it."""
    at, out = 12, []
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > len(data):
            break
        out.append((kind, data[at + 8 : at + 8 + n]))
        at += 8 + n + n % 2
    return out


def summary(payload: bytes) -> Summary:
    """What the first directory and those it points to say; damaged parts are left out."""
    mark = "<" if payload[:2] == b"II" else ">"
    found: dict = {}
    todo, seen, count, times, serial, place = [struct.unpack_from(mark + "I", payload, 4)[0]], set(), 0, {}, False, False
    while todo:
        at = todo.pop(0)
        if at in seen or len(seen) > 16:
            continue
        seen.add(at)
        try:
            d = Directory(payload, at, mark)
        except (ImageError, struct.error):
            continue
        for tag in d.fields:
            count += 1
            try:
                if tag in (_EXIF, _GPS):
                    place |= tag == _GPS
                    todo.append(d.one(tag, 0))
                elif tag == _ORIENTATION:
                    value = d.one(tag, 0)
                    found.setdefault("orientation", value if 1 <= value <= 8 else None)
                elif tag in _TEXTS:
                    found.setdefault(_TEXTS[tag], _text(d.raw(tag)))
                elif tag in _TIMES:
                    times.setdefault(tag, _text(d.raw(tag)))
                elif tag in _SERIALS:
                    serial = True
            except (ImageError, struct.error):
                continue
    when = next((times[t] for t in _TIMES if times.get(t)), None)
    return Summary(has_location=place, captured_at=when, has_serial_number=serial, tag_count=count, **found)


def _text(raw: bytes | None) -> str | None:
    return (raw or b"").split(b"\0")[0].decode("latin-1").strip() or None


def upright(payload: bytes) -> bytes:
    """The payload with the first directory's orientation set to 1."""
    mark = "<" if payload[:2] == b"II" else ">"
    try:
        d = Directory(payload, struct.unpack_from(mark + "I", payload, 4)[0], mark)
    except (ImageError, struct.error):
        return payload
    kind, count, at = d.fields.get(_ORIENTATION, (0, 0, 0))
    if kind != 3 or count != 1:
        return payload
    return payload[:at] + struct.pack(mark + "H", 1) + payload[at + 2 :]


def icc_of(data: bytes, fmt: str) -> bytes | None:
    """The colour profile in a file of ``fmt``; None if there is none. That of a PNG is inflated."""
    try:
        if fmt == "jpeg":
            return jpeg.icc(data)
        if fmt in ("png", "apng"):
            body = next((b for k, b in png.chunks(data) if k == b"iCCP"), b"")
            return zlib.decompress(body.partition(b"\0")[2][1:]) if body else None
        if fmt == "webp":
            return next((b for k, b in riff_chunks(data) if k == b"ICCP"), None)
        if fmt == "tiff":
            return directories(data)[1][0].raw(_PROFILE)
    except (ImageError, struct.error, zlib.error, IndexError, KeyError):
        pass
    return None


def declares_wide_gamut(data: bytes, fmt: str) -> bool:
    """Whether a file says that its colours are wide: by its profile, or a PNG's code points."""
    if fmt in ("png", "apng"):
        try:
            codes = next((b for k, b in png.chunks(data) if k == b"cICP"), b"")
        except ImageError:
            codes = b""
        if codes:
            return codes[0] == 12
    profile = icc_of(data, fmt)
    return bool(profile) and is_wide_gamut(profile)


_SUMMARY = (
    ("orientation", pa.int32(), "int"), ("has_location", pa.bool_(), "boolean"), ("captured_at", pa.string(), "string"), ("camera_make", pa.string(), "string"), ("camera_model", pa.string(), "string"),
    ("software", pa.string(), "string"), ("has_serial_number", pa.bool_(), "boolean"), ("tag_count", pa.int32(), "int"),
)


def metadata(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row for each of ``files``: key, format, has_exif, what the EXIF says (see :class:`Summary`), has_icc and wide_gamut.

    The format is a column expression; a null, empty or unknown file has a null format and no metadata.
    """
    from .detect import format_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, fmt = batch.column(1)[i].as_py() or b"", batch.column(2)[i].as_py() or ""
                payload = payload_of(data, fmt)
                said = summary(payload).row() if payload else {}
                rows.append((payload is not None, *(said.get(n) for n, _, _ in _SUMMARY), icc_of(data, fmt) is not None, declares_wide_gamut(data, fmt)))
            kinds = [pa.bool_(), *(t for _, t, _ in _SUMMARY), pa.bool_(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["key", "format", "has_exif", *(n for n, _, _ in _SUMMARY), "has_icc", "wide_gamut"])

    seen = files.select(F.col(key).alias("key"), F.col(content).alias("content"), format_of(F.col(content)).alias("format"))
    ddl = f"key {files.schema[key].dataType.simpleString()}, format string, has_exif boolean, {', '.join(f'{n} {d}' for n, _, d in _SUMMARY)}, has_icc boolean, wide_gamut boolean"
    return seen.mapInArrow(run, ddl).withColumnRenamed("key", key)


def is_wide_gamut(icc: bytes) -> bool:
    """Whether all three colourants of a profile are Display P3's, within 0.02."""
    want = {b"rXYZ": (0.51512, 0.2412, -0.00105), b"gXYZ": (0.29198, 0.69225, 0.04189), b"bXYZ": (0.1571, 0.06657, 0.78407)}
    if len(icc) < 132:
        return False
    n, got = struct.unpack_from(">I", icc, 128)[0], {}
    for i in range(min(n, 200)):
        if 132 + 12 * i + 12 > len(icc):
            return False
        tag, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * i)
        if tag in want and size >= 20 and at + 20 <= len(icc):
            got[tag] = [v / 65536 for v in struct.unpack_from(">3i", icc, at + 8)]
    return len(got) == 3 and all(abs(a - b) <= 0.02 for t in want for a, b in zip(want[t], got[t], strict=True))
