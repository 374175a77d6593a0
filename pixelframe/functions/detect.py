"""What a file is, from its bytes: :func:`sniff` on bytes and :func:`format_of` as a column.

Both go through the same signatures in the same order; what needs a walk through the file (animated PNG,
camera TIFF, box brands) is bounded and written out for the column too.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EmptyInput, UnknownFormat

HEAD = 128
#: Signatures at the start, in order; brands of the box formats.
_FIRST = (("jpeg", b"\xff\xd8\xff"), ("jxl", b"\xff\x0a"), ("gif", b"GIF87a"), ("gif", b"GIF89a"))
_THEN = (
    ("qoi", b"qoif"), ("farbfeld", b"farbfeld"), ("bmp", b"BM"), ("psd", b"8BPS"), ("dds", b"DDS "), ("icns", b"icns"), ("exr", b"\x76\x2f\x31\x01"),
    ("ras", b"\x59\xa6\x6a\x95"), ("raw", b"FUJIFILMCCD-RAW"),
)
_RAW = (b"IIRO", b"IIRS", b"MMOR", b"II\x55\0")
_HEIF = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs", "mif1", "msf1", "miaf")
_AVIF = ("avif", "avis", "av01")
_PNG = b"\x89PNG\r\n\x1a\n"


def _animated(data: bytes) -> bool:
    at = 8
    for _ in range(256):
        if at + 8 > len(data):
            return False
        n, kind = struct.unpack_from(">i4s", data, at)
        if n < 0 or kind in (b"IDAT", b"IEND"):
            return False
        if kind == b"acTL":
            return True
        at += 12 + n
    return False


def _camera(data: bytes) -> bool:
    """A DNG, or a TIFF whose first directory is reduced and has sub-directories."""
    mark = "<" if data[:1] == b"I" else ">"
    if len(data) < 16:
        return False
    at = struct.unpack_from(mark + "I", data, 4)[0]
    if at < 8 or at + 2 > len(data):
        return False
    n = struct.unpack_from(mark + "H", data, at)[0]
    if not 1 <= n <= 512 or at + 2 + 12 * n > len(data):
        return False
    tags = [struct.unpack_from(mark + "HHII", data, at + 2 + 12 * i) for i in range(n)]
    if any(t[0] == 0xC612 for t in tags):
        return True
    return any(t[0] == 0xFE and t[1] == 4 and t[3] & 1 for t in tags) and any(t[0] == 0x14A for t in tags)


def _brands(data: bytes) -> list[str]:
    end = min(struct.unpack_from(">I", data)[0], len(data))
    return [data[at : at + 4].decode("latin-1") for at in (8, *range(16, end - 3, 4))]


def _pcx(data: bytes) -> bool:
    if len(data) < 128 or data[0] != 10 or data[1] not in (0, 2, 3, 4, 5) or data[2] > 1 or data[3] not in (1, 2, 4, 8) or not 1 <= data[65] <= 4:
        return False
    x0, y0, x1, y1 = struct.unpack_from("<4H", data, 4)
    return x1 >= x0 and y1 >= y0


def _tga(data: bytes) -> bool:
    if len(data) >= 18 and data[-18:-2] == b"TRUEVISION-XFILE":
        return True
    return len(data) >= 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 15, 16, 24, 32) and (data[2] in (1, 9)) == (data[1] == 1)


def sniff(data: bytes) -> str | None:
    head = data[:HEAD]
    if head.startswith(_PNG):
        return "apng" if _animated(data) else "png"
    for name, mark in _FIRST:
        if head.startswith(mark):
            return name
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    for name, mark in _THEN:
        if head.startswith(mark):
            return name
    if head[:4] in (b"\0\0\1\0", b"\0\0\2\0") and len(head) >= 6 and head[4:6] != b"\0\0":
        return "ico"
    if head[:4] in _RAW:
        return "raw"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "raw" if head[8:10] == b"CR" or _camera(data) else "tiff"
    if head[:4] in (b"II+\0", b"MM\0+"):
        return "tiff"
    if len(head) >= 12 and head[4:8] == b"ftyp":
        brands = _brands(data)
        for name, wanted in (("avif", _AVIF), ("raw", ("crx ",)), ("jxl", ("jxl ",)), ("heic", _HEIF)):
            if any(b in wanted for b in brands):
                return name
    if head.startswith(b"\0\0\0\x0cJXL "):
        return "jxl"
    if head[:1] == b"P" and head[1:2] in tuple(b"%d" % i for i in range(1, 8)) and head[2:3] and head[2:3] in b" \t\n\r#":
        return "pnm"
    if head[:2] == b"#?":
        line = head[2:32].split(b"\n")[0].upper()
        if b"RADIANCE" in line or b"RGBE" in line:
            return "hdr"
    if head.startswith(b"/* XPM */"):
        return "xpm"
    if head.startswith(b"#define") and b"_width" in head:
        return "xbm"
    text = head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\n\r")[:14].lower()
    if text.startswith((b"<?xml", b"<svg", b"<!doctype svg")):
        return "svg"
    return "pcx" if _pcx(data) else "tga" if _tga(data) else None


def required(data: bytes) -> str:
    if not data:
        raise EmptyInput("the file is empty")
    found = sniff(data)
    if found is None:
        raise UnknownFormat("the file is no image that is known")
    return found


# ---------------------------------------------------------------- as a column


def u8(content: Column, at: int | Column) -> Column:
    """The byte at a place counted from 0; null past the end."""
    piece = F.substring(content, at + 1, 1) if isinstance(at, int) else F.substring(content, at + 1, F.lit(1))
    return F.when(F.octet_length(piece) == 1, F.conv(F.hex(piece), 16, 10).cast("int"))


def unsigned(content: Column, at: int | Column, size: int, little: bool = False) -> Column:
    """An unsigned number of ``size`` bytes; null past the end."""
    place = (lambda i: at + i) if isinstance(at, int) else (lambda i: at + F.lit(i))
    total = F.lit(0).cast("long")
    for i in range(size):
        total = total + u8(content, place(i)).cast("long") * (1 << 8 * (i if little else size - 1 - i))
    return total


def starts(content: Column, mark: bytes, at: int = 0) -> Column:
    return F.substring(content, at + 1, len(mark)) == F.lit(mark)


def format_of(content: Column) -> Column:
    """The format of a binary column by the same rules as :func:`sniff`; null if unknown or empty."""
    head = F.substring(content, 1, HEAD)
    # Latin-1 text of the head: every byte is one character.
    text = F.decode(head, "ISO-8859-1")
    size = F.octet_length(content)

    def walk(state: Column, _: Column) -> Column:
        at, open_ = state["at"], state["found"].isNull()
        n, kind = unsigned(content, at, 4), F.decode(F.substring(content, at + 5, F.lit(4)), "ISO-8859-1")
        ends = (at + 8 > size) | (n >= 1 << 31) | kind.isin("IDAT", "IEND")
        found = F.when(F.coalesce(ends, F.lit(True)), F.lit(False)).when(kind == "acTL", F.lit(True))
        return F.when(open_, F.struct((at + 12 + F.coalesce(n, F.lit(0))).cast("long").alias("at"), found.alias("found"))).otherwise(state)

    start = F.struct(F.lit(8).cast("long").alias("at"), F.lit(None).cast("boolean").alias("found"))
    animated = F.aggregate(F.sequence(F.lit(1), F.lit(256)), start, walk, lambda s: F.coalesce(s["found"], F.lit(False)))
    out = F.when(starts(content, _PNG), F.when(animated, "apng").otherwise("png"))
    for name, mark in _FIRST:
        out = out.when(starts(content, mark), name)
    out = out.when(starts(content, b"RIFF") & starts(content, b"WEBP", 8), "webp")
    for name, mark in _THEN:
        out = out.when(starts(content, mark), name)
    out = out.when((starts(content, b"\0\0\1\0") | starts(content, b"\0\0\2\0")) & (unsigned(content, 4, 2, True) > 0), "ico")
    for mark in _RAW:
        out = out.when(starts(content, mark), "raw")
    for mark, little in ((b"II*\0", True), (b"MM\0*", False)):
        out = out.when(starts(content, mark), F.when(starts(content, b"CR", 8) | F.coalesce(_camera_column(content, size, little), F.lit(False)), "raw").otherwise("tiff"))
    out = out.when(starts(content, b"II+\0") | starts(content, b"MM\0+"), "tiff")
    end = F.least(unsigned(content, 0, 4), size.cast("long"))
    places = F.when(end >= 20, F.sequence(F.lit(17).cast("long"), end - 3, F.lit(4).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    brand = lambda at: F.decode(F.substring(content, at.cast("int"), F.lit(4)), "ISO-8859-1")
    brands = F.transform(F.concat(F.array(F.lit(9).cast("long")), places), brand)
    box = starts(content, b"ftyp", 4) & (size >= 12)
    for name, wanted in (("avif", _AVIF), ("raw", ("crx ",)), ("jxl", ("jxl ",)), ("heic", _HEIF)):
        out = out.when(box & F.arrays_overlap(brands, F.array(*map(F.lit, wanted))), name)
    out = out.when(starts(content, b"\0\0\0\x0cJXL "), "jxl").when(text.rlike(r"^P[1-7][ \t\n\r#]"), "pnm")
    out = out.when(F.substring(text, 1, 32).rlike(r"^#\?(?i:[^\n]*(RADIANCE|RGBE))"), "hdr").when(F.startswith(text, F.lit("/* XPM */")), "xpm")
    out = out.when(F.startswith(text, F.lit("#define")) & F.contains(text, F.lit("_width")), "xbm").when(text.rlike(r"^(\xef\xbb\xbf)?[ \t\n\r]*(?i:<\?xml|<svg|<!doctype svg)"), "svg")
    b = lambda i: u8(content, i)
    pcx = (size >= 128) & (b(0) == 10) & b(1).isin(0, 2, 3, 4, 5) & (b(2) <= 1) & b(3).isin(1, 2, 4, 8) & b(65).between(1, 4)
    le = lambda i: unsigned(content, i, 2, True)
    out = out.when(pcx & (le(8) >= le(4)) & (le(10) >= le(6)), "pcx")
    footer = F.substring(content, -18, 16) == F.lit(b"TRUEVISION-XFILE")
    tga = b(1).isin(0, 1) & b(2).isin(1, 2, 3, 9, 10, 11) & b(16).isin(8, 15, 16, 24, 32) & (b(2).isin(1, 9) == (b(1) == 1))
    return out.when((size >= 18) & (footer | tga), "tga")


def _camera_column(content: Column, size: Column, little: bool) -> Column:
    at = unsigned(content, 4, 4, little)
    n = unsigned(content, at, 2, little)
    legal = (size >= 16) & (at >= 8) & n.between(1, 512) & (at + 2 + n * 12 <= size)
    entries = F.when(legal, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: at + 2 + i * 12)).otherwise(F.array().cast("array<bigint>"))
    tag = lambda e: unsigned(content, e, 2, little)
    reduced = F.exists(entries, lambda e: (tag(e) == 0xFE) & (unsigned(content, e + 2, 2, little) == 4) & (unsigned(content, e + 8, 4, little) % 2 == 1))
    return F.exists(entries, lambda e: tag(e) == 0xC612) | (reduced & F.exists(entries, lambda e: tag(e) == 0x14A))


# ---------------------------------------------------------------- sizes from headers


def measure(content: Column, fmt: Column) -> Column:
    """(width, height) from the header of a PNG, GIF, PSD or PCX, before anything is inflated; null for others."""
    sized = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    return (
        F.when(fmt.isin("png", "apng"), sized(unsigned(content, 16, 4), unsigned(content, 20, 4)))
        .when(fmt == "gif", sized(unsigned(content, 6, 2, True), unsigned(content, 8, 2, True)))
        .when(fmt == "psd", sized(unsigned(content, 18, 4), unsigned(content, 14, 4)))
        .when(fmt == "pcx", sized(unsigned(content, 8, 2, True) - unsigned(content, 4, 2, True) + 1, unsigned(content, 10, 2, True) - unsigned(content, 6, 2, True) + 1))
    )
