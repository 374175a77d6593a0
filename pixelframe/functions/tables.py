"""Table functions: what is inside a file, as rows.

``register_all(spark)`` makes them known to SQL: ``SELECT t.* FROM files, LATERAL png_chunks(content) t``.
A file that cannot be walked gives the rows before its damage.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..codecs import icns, ico, png, tiff
from ..containers import boxes, heif
from ..errors import ImageError
from .exif import payload_of, riff_chunks


def _quiet(rows: Iterator[tuple]) -> Iterator[tuple]:
    try:
        yield from rows
    except ImageError:
        return


@udtf(returnType="number int, type string, size bigint")
class PngChunks:
    def eval(self, content: bytes):
        yield from _quiet((i, k.decode("latin-1"), len(b)) for i, (k, b) in enumerate(_listed(png.chunks, content)))


@udtf(returnType="number int, type string, size bigint")
class RiffChunks:
    def eval(self, content: bytes):
        yield from ((i, k.decode("latin-1"), len(b)) for i, (k, b) in enumerate(riff_chunks(content or b"")))


@udtf(returnType="type string, start bigint, size bigint")
class IsoBoxes:
    def eval(self, content: bytes):
        yield from _quiet((b.type, b.start, b.end - b.start) for b in boxes.walk(content or b""))


@udtf(returnType="width int, height int, bits int, offset bigint, size bigint, is_png boolean")
class IcoEntries:
    def eval(self, content: bytes):
        yield from _quiet((e.width, e.height, e.bits, e.offset, e.size, e.is_png) for e in _listed(ico.directory, content))


@udtf(returnType="type string, kind string, side int, retina boolean, offset bigint, size bigint")
class IcnsEntries:
    def eval(self, content: bytes):
        yield from _quiet((e.type, e.kind, e.side, e.retina, e.offset, e.size) for e in _listed(icns.directory, content))


@udtf(returnType="directory int, tag int, kind int, count bigint")
class TiffTags:
    def eval(self, content: bytes):
        yield from _quiet((i, tag, kind, count) for i, d in enumerate(_listed(lambda c: tiff.directories(c)[1], content)) for tag, (kind, count, _) in d.fields.items())


@udtf(returnType="id bigint, type string, hidden boolean, size bigint")
class HeifItems:
    def eval(self, content: bytes):
        yield from _quiet((i.id, i.type, i.hidden, sum(n for _, n in i.extents)) for i in _listed(lambda c: heif.parse(c).items.values(), content))


@udtf(returnType="ref_type string, from_id bigint, to_id bigint")
class HeifReferences:
    def eval(self, content: bytes):
        yield from _quiet(iter(_listed(lambda c: heif.parse(c).references, content)))


@udtf(returnType="x int, y int, width int, height int, item bigint")
class HeifTiles:
    def eval(self, content: bytes):
        yield from _quiet((t.x, t.y, t.width, t.height, t.item) for t in _listed(lambda c: heif.plan(c).picture.tiles, content))


@udtf(returnType="tag int, kind int, count bigint")
class ExifTags:
    def eval(self, content: bytes, fmt: str):
        payload = payload_of(content or b"", fmt or "")
        if payload:
            yield from _quiet((tag, kind, count) for d in tiff.directories(payload)[1][:1] for tag, (kind, count, _) in d.fields.items())


def _listed(read, content):
    try:
        return list(read(content or b""))
    except ImageError:
        return []


TABLES = {
    "png_chunks": PngChunks, "riff_chunks": RiffChunks, "iso_boxes": IsoBoxes, "ico_entries": IcoEntries, "icns_entries": IcnsEntries, "tiff_tags": TiffTags,
    "heif_items": HeifItems, "heif_references": HeifReferences, "heif_tiles": HeifTiles, "exif_tags": ExifTags,
}


def register_all(spark: SparkSession) -> None:
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
