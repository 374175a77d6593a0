"""Queries over files that column expressions put together byte by byte, so that no writer of ours is read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import formats_table
from ..functions import detect, naming
from ..functions.exif import metadata
from ..functions.tables import register_all
from ..raster import Decoded, Frame, mirror, rotate
from ..registry import Options, capabilities, default_registry
from ..sources import images as sources
from .convert import Settings, convert, convert_bytes
from .queries import _checked, _docs, _query
from .synth import HEIGHT, SAMPLES, WIDTH, sums_of, table, text_pixels
from .synth import images as synth_images

CHECK = "16 AS width, 12 AS height, 192::BIGINT AS n, sum(((y * 16 + x + 1)::BIGINT * (r::BIGINT + 256 * g::BIGINT + 65536 * b::BIGINT + 16777216 * a::BIGINT)) % 1000003)::BIGINT AS checksum"


def little(value: Column | int, n: int) -> Column:
    """``n`` bytes as hex, the least first."""
    if isinstance(value, int):
        return F.lit(value.to_bytes(n, "little").hex())
    digits = F.lpad(F.hex(value), 2 * n, "0")
    return F.concat(*(F.substring(digits, 2 * (n - k) - 1, 2) for k in range(n)))


def big(value: Column | int, n: int) -> Column:
    return F.lit(value.to_bytes(n, "big").hex()) if isinstance(value, int) else F.lpad(F.hex(value), 2 * n, "0")


def _hexed(pixels: DataFrame, at: Column, orders: dict[str, str], wide: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """(image_id, one column for each of ``orders``, ``more``): the channels' bytes as hex, twice for ``wide``, in the order of ``at``; ``more`` are aggregates."""

    def hexed(name: str, channels: str) -> Column:
        digits, times = (4, 257) if name in wide else (2, 1)
        value = F.lit(0).cast("long")
        for c in channels:
            value = F.shiftleft(value, 4 * digits).bitwiseOR(F.col(c).cast("long") * times)
        return F.lpad(F.hex(value), digits * len(channels), "0")

    listed = F.sort_array(F.collect_list(F.struct(at.alias("at"), *(hexed(name, channels).alias(name) for name, channels in orders.items()))))
    rows = pixels.groupBy("image_id").agg(listed.alias("listed"), *more)
    return rows.select("image_id", *(F.array_join(F.col(f"listed.{name}"), "").alias(name) for name in orders), *(c for c in rows.columns if c not in ("image_id", "listed")))


def _place() -> Column:
    return F.col("y") * WIDTH + F.col("x")


def _read_back(files: DataFrame) -> DataFrame:
    return _checked(sources.to_pixels(sources.decode(files, key="image_id")))


def _files(rows: DataFrame, *parts: Column) -> DataFrame:
    return rows.select("image_id", F.unhex(F.concat(*parts)).alias("content"))


_PLANES = {c: c for c in "rgb"}


def _psd(spark: SparkSession, d: str) -> DataFrame:
    """A flat document of three planes."""
    return _files(_hexed(text_pixels(_docs(spark, d)), _place(), _PLANES), *_psd_parts())


def _psd_parts() -> tuple[Column | str, ...]:
    head = F.lit(b"8BPS".hex() + "0001" + "00" * 6 + "0003" + f"{HEIGHT:08x}{WIDTH:08x}" + "0008" + "0003" + "00000000" * 3 + "0000")
    return head, "r", "g", "b"


@_query("q_built_psd", f" SELECT image_id, {CHECK} FROM px GROUP BY image_id")
def q_built_psd(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_psd(spark, d))


@_query("q_built_dds", f" SELECT image_id, {CHECK} FROM pa GROUP BY image_id")
def q_built_dds(spark: SparkSession, d: str) -> DataFrame:
    """A surface of 32 bits a pixel with masks."""
    rows = _hexed(text_pixels(_docs(spark, d), alpha=True), _place(), {"body": "bgra"})
    numbers = (124, 0x100F, HEIGHT, WIDTH, WIDTH * 4, 0, 0, *(0,) * 11, 32, 0x41, 0, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000, 0x1000, 0, 0, 0, 0)
    return _read_back(_files(rows, F.lit(b"DDS ".hex()), *(little(n, 4) for n in numbers), "body"))


def _ico(spark: SparkSession, d: str) -> DataFrame:
    """An icon of one bitmap, its rows from the bottom up, with a mask after it."""
    rows = _hexed(text_pixels(_docs(spark, d), alpha=True), (HEIGHT - 1 - F.col("y")) * WIDTH + F.col("x"), {"body": "bgra"})
    size = 40 + WIDTH * HEIGHT * 4 + HEIGHT * 4
    head = [little(0, 2), little(1, 2), little(1, 2), F.lit(f"{WIDTH:02x}{HEIGHT:02x}0000"), little(1, 2), little(32, 2), little(size, 4), little(22, 4)]
    dib = [little(40, 4), little(WIDTH, 4), little(2 * HEIGHT, 4), little(1, 2), little(32, 2), *(little(0, 4) for _ in range(6))]
    return _files(rows, *head, *dib, "body", F.lit("00000000" * HEIGHT))


@_query("q_built_ico", f" SELECT image_id, {CHECK} FROM pa GROUP BY image_id")
def q_built_ico(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_ico(spark, d))


def _tiff(spark: SparkSession, d: str) -> DataFrame:
    """Big-endian, its rows in two strips without compression."""
    rows = _hexed(text_pixels(_docs(spark, d)), _place(), {"body": "rgb"})
    strip = WIDTH * 3 * HEIGHT // 2
    begin = 8 + 2 + 10 * 12 + 4
    bits, offsets, sizes = begin, begin + 6, begin + 14
    fields = [(256, 3, 1, WIDTH << 16), (257, 3, 1, HEIGHT << 16), (258, 3, 3, bits), (259, 3, 1, 1 << 16), (262, 3, 1, 2 << 16), (273, 4, 2, offsets), (277, 3, 1, 3 << 16), (278, 3, 1, HEIGHT // 2 << 16), (279, 4, 2, sizes), (284, 3, 1, 1 << 16)]
    head = F.lit("4d4d002a00000008" + f"{len(fields):04x}" + "".join(f"{t:04x}{k:04x}{n:08x}{v:08x}" for t, k, n, v in fields) + "00000000" + "0008" * 3 + f"{begin + 22:08x}{begin + 22 + strip:08x}" + f"{strip:08x}" * 2)
    return _files(rows, head, "body")


@_query("q_built_tiff", f" SELECT image_id, {CHECK} FROM px GROUP BY image_id")
def q_built_tiff(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_tiff(spark, d))


def _png16(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen bits a channel in a stored deflate block, a file for each document, whatever its id; both checksums are computed from the bytes."""
    listed = F.sort_array(F.collect_list(F.struct("y", "line")))
    files = _png16_lines(_docs(spark, d)).groupBy("image_id", "document").agg(listed.alias("listed"), F.sum("once").alias("once"), F.sum("often").alias("often"))
    lines = F.hex(F.concat(*(F.col("listed")[k]["line"] for k in range(HEIGHT))))
    return _files(files.select("image_id", _png16_packed(lines).alias("packed")), *_png16_parts())


def _png16_lines(docs: DataFrame) -> DataFrame:
    """The pixels with alpha by lines, as the file has them: a filter byte, then every channel's byte twice; and a line's part in both sums of Adler-32.

    Byte i of n is in the first sum once and in the second n - i times. A line is one row, where the relation of pixels has sixteen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        p = np.arange(WIDTH * HEIGHT)
        times = _PNG16_SIZE - np.arange(_PNG16_SIZE, dtype=np.int32).reshape(HEIGHT, -1)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            n = batch.num_rows
            sums = sums_of(batch.column("text"), SAMPLES)
            rgba = np.concatenate([sums.reshape(n, -1, 3), (255 - (sums[:, 7 * p % SAMPLES] & 0xC0))[..., None]], axis=2)
            lines = np.zeros((n, HEIGHT, 1 + WIDTH * 8), np.uint8)
            lines[..., 1:] = np.repeat(rgba.reshape(n, HEIGHT, -1), 2, axis=2)
            ends = np.arange(n * HEIGHT + 1, dtype=np.int32) * lines.shape[2]
            rows = pa.array(np.repeat(np.arange(n), HEIGHT))
            yield pa.RecordBatch.from_arrays([
                batch.column("image_id").take(rows), batch.column("document").take(rows), pa.array(np.tile(np.arange(HEIGHT, dtype=np.int32), n)),
                pa.Array.from_buffers(pa.binary(), n * HEIGHT, [None, pa.py_buffer(ends), pa.py_buffer(lines)]),
                pa.array(lines.sum(axis=2, dtype=np.int64).ravel()), pa.array((lines * times).sum(axis=2, dtype=np.int64).ravel()),
            ], names=["image_id", "document", "y", "line", "once", "often"])

    texts = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").alias("image_id"), F.monotonically_increasing_id().alias("document"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "image_id bigint, document bigint, y int, line binary, once bigint, often bigint")


_PNG16_SIZE = HEIGHT * (1 + WIDTH * 8)


def _adler_sums() -> tuple[Column, Column]:
    """Adler-32 in closed form: byte i of n is in the first sum once and in the second n - i times; a channel has two equal bytes, filter bytes are 0."""
    left = _PNG16_SIZE - (F.col("y") * (1 + WIDTH * 8) + 1 + F.col("x") * 8)
    once = F.sum(2 * (F.col("r") + F.col("g") + F.col("b") + F.col("a")))
    often = F.sum(sum((F.col(c) * (2 * (left - 2 * k) - 1) for k, c in enumerate("rgba")), F.lit(0)))
    return once.alias("once"), often.alias("often")


def _png16_packed(lines: Column) -> Column:
    """The stored block around the lines' hex."""
    n = _PNG16_SIZE
    adler = F.pmod(n + F.col("often"), F.lit(65521)) * 65536 + F.pmod(1 + F.col("once"), F.lit(65521))
    return F.concat(F.lit("780101"), little(n, 2), little(65535 - n, 2), lines, big(adler, 4))


def _png16_parts() -> tuple[Column, ...]:
    """The chunks around the column packed, which is computed before as it is in a checksum too."""

    def chunk(kind: bytes, body: Column, size: int) -> Column:
        return F.concat(big(size, 4), F.lit(kind.hex()), body, big(F.crc32(F.unhex(F.concat(F.lit(kind.hex()), body))), 4))

    head = chunk(b"IHDR", F.lit(f"{WIDTH:08x}{HEIGHT:08x}1006000000"), 13)
    return F.lit("89504e470d0a1a0a"), head, chunk(b"IDAT", F.col("packed"), _PNG16_SIZE + 11), chunk(b"IEND", F.lit(""), 0)


@_query("q_built_png16", f" SELECT image_id, {CHECK} FROM pa GROUP BY image_id")
def q_built_png16(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(_png16(spark, d))


# ---------------------------------------------------------------- JPEG


@_query("q_roundtrip_jpeg", "SELECT image_id, TRUE AS within FROM (SELECT doc_id AS image_id FROM documents WHERE octet_length(encode(text)) > 0)", plain=True)
def q_roundtrip_jpeg(spark: SparkSession, d: str) -> DataFrame:
    """At the best quality no channel is off by more than rounding in two colour spaces and a transform can make it."""
    pictures = synth_images(_docs(spark, d))
    back = sources.decode(sources.encode(pictures, "jpeg", options=Options(quality=100)), key="image_id").select("image_id", F.col("image.data").alias("back"))
    both = pictures.join(back, "image_id").select("image_id", F.col("image.data").alias("a"), F.col("back").alias("b"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            off = [int(np.abs(np.frombuffer(a.as_py(), np.uint8).astype(int) - np.frombuffer(b.as_py(), np.uint8)).max()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(off, pa.int32())], names=["image_id", "off"])

    return both.mapInArrow(far, "image_id bigint, off int").select("image_id", (F.col("off") <= 4).alias("within"))


@_query("q_raw_preview", "SELECT image_id, 'raw-preview' AS decoder, 16 AS width, 12 AS height, 'png' AS target FROM (SELECT doc_id AS image_id FROM documents WHERE octet_length(encode(text)) > 0)", plain=True)
def q_raw_preview(spark: SparkSession, d: str) -> DataFrame:
    """A camera's file with a small preview and the larger one behind it, converted."""
    pictures = synth_images(_docs(spark, d))
    large = sources.encode(pictures, "jpeg").select("image_id", F.hex("content").alias("large"))
    small = sources.encode(pictures.limit(1), "jpeg", options=Options(quality=20)).select(F.hex("content").alias("small")).scalar()
    made = large.select("image_id", F.unhex(F.concat(F.lit(b"FUJIFILMCCD-RAW 0201FF000000".hex().ljust(200, "0")), small, F.lit("00" * 37), "large", F.lit("0102"))).alias("content"))
    out = convert(made, Settings(to="png"), key="image_id")
    return out.select("image_id", F.col("report.decoder").alias("decoder"), F.col("report.width").alias("width"), F.col("report.height").alias("height"), F.col("report.target_format").alias("target"))


# ---------------------------------------------------------------- metadata


@_query("q_exif_summary", """SELECT doc_id AS image_id, 'jpeg' AS format, TRUE AS has_exif, (doc_id % 8 + 1)::INT AS orientation, doc_id % 2 = 1 AS has_location, '2024:01:02 03:04:' || lpad((doc_id % 60)::VARCHAR, 2, '0') AS captured_at,
    'Maker' || (doc_id % 10) AS camera_make, NULL::VARCHAR AS camera_model, FALSE AS has_serial_number, (CASE WHEN doc_id % 2 = 1 THEN 5 ELSE 4 END)::INT AS tag_count FROM documents""", plain=True)  # fmt: skip
def q_exif_summary(spark: SparkSession, d: str) -> DataFrame:
    """A payload of two directories, put together from columns, in the segments of a file without pixels."""
    i = F.col("doc_id")
    ascii_ = lambda c, n: F.rpad(F.hex(c), 2 * n, "0")
    field = lambda tag, kind, n, value: F.concat(little(tag, 2), little(kind, 2), little(n, 4), value)
    located = i % 2 == 1
    first = 8 + 2 + 12 * 3 + 4
    at_exif = first + 8
    at_time = at_exif + 2 + 12 + 4
    at_gps = at_time + 20
    make = F.concat(F.lit("Maker"), (i % 10).cast("string"))
    time = F.concat(F.lit("2024:01:02 03:04:"), F.lpad((i % 60).cast("string"), 2, "0"))
    second = F.concat(little(1, 2), field(0x9003, 2, 20, little(at_time, 4)), little(0, 4), ascii_(time, 20))
    gps = F.concat(little(0, 2), little(0, 4))
    plain = F.concat(little(3, 2), field(0x010F, 2, 7, little(first, 4)), field(0x0112, 3, 1, F.concat(little(i % 8 + 1, 2), little(0, 2))), field(0x8769, 4, 1, little(at_exif, 4)), little(0, 4), ascii_(make, 8), second)
    # With a fourth field in the first directory all that is after it moves by twelve bytes.
    moved = F.concat(little(4, 2), field(0x010F, 2, 7, little(first + 12, 4)), field(0x0112, 3, 1, F.concat(little(i % 8 + 1, 2), little(0, 2))), field(0x8769, 4, 1, little(at_exif + 12, 4)), field(0x8825, 4, 1, little(at_gps + 12, 4)), little(0, 4), ascii_(make, 8))
    moved = F.concat(moved, little(1, 2), field(0x9003, 2, 20, little(at_time + 12, 4)), little(0, 4), ascii_(time, 20), gps)
    payload = F.concat(F.lit("49492a0008000000"), F.when(located, moved).otherwise(plain))
    body = F.concat(F.lit(b"Exif\0\0".hex()), payload)
    content = F.unhex(F.concat(F.lit("ffd8ffe1"), big((F.length(body) / 2 + 2).cast("int"), 2), body, F.lit("ffd9")))
    out = metadata(_docs(spark, d).select(F.col("doc_id").alias("image_id"), content.alias("content")), key="image_id")
    return out.select("image_id", "format", "has_exif", "orientation", "has_location", "captured_at", "camera_make", "camera_model", "has_serial_number", "tag_count")


# ---------------------------------------------------------------- animations through convert


@_query("q_animation_trip", """, hard AS (SELECT image_id, y, x, CASE WHEN a < 128 THEN 0 ELSE r END AS r, CASE WHEN a < 128 THEN 0 ELSE g END AS g, CASE WHEN a < 128 THEN 0 ELSE b END AS b, CASE WHEN a < 128 THEN 0 ELSE 255 END AS a FROM pf),
    shown AS (SELECT image_id, f AS frame, CASE f WHEN 2 THEN 11 - y ELSE y END AS y, CASE f WHEN 0 THEN x ELSE 15 - x END AS x, r, g, b, a FROM hard, (SELECT unnest(range(3))::INT AS f))
    SELECT image_id, frame, (100 * (frame + 1))::DOUBLE AS delay_ms, sum(((y * 16 + x + 1)::BIGINT * (r::BIGINT + 256 * g::BIGINT + 65536 * b::BIGINT + 16777216 * a::BIGINT)) % 1000003)::BIGINT AS checksum FROM shown GROUP BY image_id, frame""")  # fmt: skip
def q_animation_trip(spark: SparkSession, d: str) -> DataFrame:
    """Three frames (as it is, mirrored, turned half round) written as GIF, converted to APNG and read frame by frame."""
    registry = default_registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        place = (np.arange(WIDTH * HEIGHT, dtype=np.int64) + 1).reshape(HEIGHT, WIDTH)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                image = sources.unpacked(batch.column(1)[i].as_py())
                clear = image.data[..., 3] < 128
                image.data = np.where(clear[..., None], 0, np.concatenate([image.data[..., :3], np.full_like(image.data[..., 3:], 255)], axis=2)).astype(np.uint8)
                image.has_alpha = bool(clear.any())
                frames = [Frame(x, 100.0 * (k + 1)) for k, x in enumerate((image, mirror(image, "horizontal"), rotate(image, 180)))]
                gif, _ = registry.encode(Decoded(image, frames, 0), "gif", Options())
                made, _ = convert_bytes(gif, Settings(to="apng"), registry)
                found, _ = registry.decode(made, "apng", 10**9)
                for k, f in enumerate(found.frames):
                    value = f.image.data.astype(np.int64) @ np.array([1, 256, 65536, 16777216], np.int64)
                    rows.append((batch.column(0)[i].as_py(), k, f.delay_ms, int((place * value % 1000003).sum())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", "frame", "delay_ms", "checksum"])

    return synth_images(_docs(spark, d), alpha=True, few=True).mapInArrow(run, "image_id bigint, frame int, delay_ms double, checksum bigint")


# ---------------------------------------------------------------- containers, capabilities


def _box(kind: bytes, *parts: str) -> str:
    body = "".join(parts)
    return f"{len(body) // 2 + 8:08x}{kind.hex()}{body}"


@_query("q_built_heif", "SELECT image_id, 'heic-jpeg' AS decoder, 16 AS width, 12 AS height, TRUE AS within FROM (SELECT doc_id AS image_id FROM documents WHERE octet_length(encode(text)) > 0)", plain=True)
def q_built_heif(spark: SparkSession, d: str) -> DataFrame:
    """A grid of two coded tiles, its boxes and offsets put together from columns; no channel is off by more than 4."""
    import numpy as np

    from ..raster import crop, opaque

    registry = default_registry()

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                image = sources.unpacked(batch.column(1)[i].as_py())
                two = [registry.encode(Decoded(crop(image, x, 0, 8, HEIGHT)), "jpeg", Options(quality=100))[0] for x in (0, 8)]
                rows.append((batch.column(0)[i].as_py(), *two, image.data.tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", "left", "right", "data"])

    tiles = synth_images(_docs(spark, d)).mapInArrow(halves, "image_id bigint, left binary, right binary, data binary")
    entry = lambda item, kind: _box(b"infe", "02000000", f"{item:04x}0000", kind.hex(), "00")
    fixed = _box(b"hdlr", "00000000" * 2, b"pict".hex(), "00" * 13) + _box(b"pitm", "00000000", "0003")
    fixed += _box(b"iinf", "00000000", "0003", entry(1, b"jpeg"), entry(2, b"jpeg"), entry(3, b"grid")) + _box(b"iref", "00000000", _box(b"dimg", "0003", "0002", "0001", "0002"))
    sizes = _box(b"ipco", _box(b"ispe", "00000000", f"{8:08x}{HEIGHT:08x}"), _box(b"ispe", "00000000", f"{WIDTH:08x}{HEIGHT:08x}"))
    fixed += _box(b"iprp", sizes, _box(b"ipma", "00000000", "00000003", "00010101", "00020101", "00030102"))
    head = _box(b"ftyp", b"heic".hex(), "00000000", b"mif1heic".hex())
    places = 8 + 4 + 2 + 2 + 3 * 14
    meta = 8 + 4 + len(fixed) // 2 + places
    begin = len(head) // 2 + meta + 8
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    spots = [(1, F.lit(begin + 8), n_left), (2, F.lit(begin + 8) + n_left, n_right), (3, F.lit(begin), F.lit(8))]
    located = F.concat(F.lit(f"{places:08x}{b'iloc'.hex()}00000000" + "4400" + "0003"), *(F.concat(F.lit(f"{item:04x}0000" + "0001"), big(at, 4), big(n, 4)) for item, at, n in spots))
    grid = f"00000001{WIDTH:04x}{HEIGHT:04x}"
    content = F.unhex(F.concat(F.lit(head + f"{meta:08x}{b'meta'.hex()}00000000" + fixed), located, big(n_left + n_right + 16, 4), F.lit(b"mdat".hex() + grid), F.hex("left"), F.hex("right")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                found, codec = registry.decode(batch.column(1)[i].as_py(), "heic", 10**6)
                want = opaque(np.frombuffer(batch.column(2)[i].as_py(), np.uint8).reshape(HEIGHT, WIDTH, 4)[..., :3]).data
                near = found.image.data.shape == want.shape and int(np.abs(found.image.data.astype(int) - want).max()) <= 4
                rows.append((batch.column(0)[i].as_py(), codec.id, found.image.width, found.image.height, near))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", "decoder", "width", "height", "within"])

    return tiles.select("image_id", content.alias("content"), "data").mapInArrow(read, "image_id bigint, decoder string, width int, height int, within boolean")


@_query("q_capabilities", """SELECT 'animated' AS kind, unnest(['apng', 'gif']) AS format UNION ALL SELECT 'light_in', unnest(['exr', 'hdr']) UNION ALL SELECT 'light_out', unnest(['exr', 'hdr'])
    UNION ALL SELECT 'only_read', unnest(['dds', 'heic', 'psd', 'raw']) UNION ALL SELECT 'unread', unnest(['avif', 'jxl', 'svg', 'webp'])""", plain=True)  # fmt: skip
def q_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """What the library can do by itself, beside the table of formats."""
    found = capabilities(default_registry())
    rows = [(kind, fmt) for kind in ("animated", "light_in", "light_out", "readable", "writable") for fmt in getattr(found, kind)]
    told = spark.createDataFrame(rows, "kind string, format string")
    of = lambda kind: told.where(F.col("kind") == kind).select("format")
    only = of("readable").join(of("writable"), "format", "left_anti").select(F.lit("only_read").alias("kind"), "format")
    unread = formats_table(spark).select(F.col("id").alias("format")).join(of("readable"), "format", "left_anti").select(F.lit("unread").alias("kind"), "format")
    return told.where(F.col("kind").isin("animated", "light_in", "light_out")).unionByName(only).unionByName(unread)


# ---------------------------------------------------------------- frames and their times


@_query("q_delay_rules", """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 20000000::DOUBLE ELSE (p_partkey * 37 % 400 - 60) / 4::DOUBLE END AS ms FROM part)
    SELECT p_partkey, CASE WHEN ms IS NULL OR ms <= 10 THEN 100::DOUBLE ELSE ms END AS normal, greatest(0, least(floor(coalesce(ms, 0) + 0.5::DOUBLE), 16777215))::INT AS webp FROM t""", plain=True)  # fmt: skip
def q_delay_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ms = F.when(k % 11 == 0, F.lit(None).cast("double")).when(k % 13 == 0, F.lit(20_000_000.0)).otherwise((k * 37 % 400 - 60) / F.lit(4.0))
    return table(spark, d, "part").select("p_partkey", ms.alias("ms")).select("p_partkey", naming.normalised_delay(F.col("ms")).alias("normal"), naming.webp_duration(F.col("ms")).alias("webp"))


@_query("q_frames_first", """SELECT image_id, 4 AS frames, unnest(['first', 'keep', 'keep']) AS wanted, unnest(['apng', 'apng', 'bmp']) AS target, unnest([1, 3, 1]) AS kept, unnest([1, 1, 1]) AS truncated
    FROM (SELECT doc_id AS image_id FROM documents WHERE octet_length(encode(text)) > 0)""", plain=True)  # fmt: skip
def q_frames_first(spark: SparkSession, d: str) -> DataFrame:
    """GIFs of four frames, of which three are wanted at most, converted to a still and a moving target."""
    registry = default_registry()

    def moving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.column(1):
                image = sources.unpacked(row.as_py())
                made.append(registry.encode(Decoded(image, [Frame(rotate(image, 180 * k), 50.0) for k in range(4)], 0), "gif", Options(dither=False))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["image_id", "content"])

    gifs = synth_images(_docs(spark, d), few=True).mapInArrow(moving, "image_id bigint, content binary")
    out = None
    for wanted, target in (("first", "apng"), ("keep", "apng"), ("keep", "bmp")):
        r = convert(gifs, Settings(to=target, frames=wanted, most_frames=3), key="image_id")
        kept = F.col("report.frames_kept")
        part = r.select("image_id", (F.col("report.frames") + F.col("report.frames_truncated")).alias("frames"), F.lit(wanted).alias("wanted"), F.lit(target).alias("target"), kept.alias("kept"), F.col("report.frames_truncated").alias("truncated"))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- what is inside


def _inside(spark: SparkSession, files: DataFrame, table_function: str) -> DataFrame:
    """The rows of a table function for every file."""
    register_all(spark)
    return spark.sql(f"SELECT image_id, t.* FROM {{files}}, LATERAL {table_function}(content) t", files=files)


_IDS = "(SELECT doc_id AS image_id FROM documents WHERE octet_length(encode(text)) > 0)"


@_query("q_png_chunks", f"SELECT image_id, unnest([0, 1, 2])::INT AS number, unnest(['IHDR', 'IDAT', 'IEND']) AS type, unnest([13, 1559, 0])::BIGINT AS size FROM {_IDS}", plain=True)
def q_png_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, _png16(spark, d), "png_chunks")


@_query("q_ico_entries", f"SELECT image_id, 16 AS width, 12 AS height, 32 AS bits, 22::BIGINT AS \"offset\", 856::BIGINT AS size, FALSE AS is_png FROM {_IDS}", plain=True)
def q_ico_entries(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, _ico(spark, d), "ico_entries")


@_query("q_tiff_tags", f"SELECT image_id, 0 AS directory, unnest([256, 257, 258, 259, 262, 273, 277, 278, 279, 284])::INT AS tag, unnest([3, 3, 3, 3, 3, 4, 3, 3, 4, 3])::INT AS kind, unnest([1, 1, 3, 1, 1, 2, 1, 1, 2, 1])::BIGINT AS count FROM {_IDS}", plain=True)
def q_tiff_tags(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, _tiff(spark, d), "tiff_tags")


@_query("q_measure_built", f"SELECT image_id, kind, 16 AS width, 12 AS height FROM {_IDS}, (SELECT unnest(['png', 'psd']) AS kind)", plain=True)
def q_measure_built(spark: SparkSession, d: str) -> DataFrame:
    """Sizes by the column expressions, from headers that no writer of ours made; both files of an image are made in one pass."""
    rows = _hexed(text_pixels(_docs(spark, d), alpha=True), _place(), {"body": "rgba"} | _PLANES, wide=("body",), more=_adler_sums())
    line = WIDTH * 16
    lines = F.concat(*(F.concat(F.lit("00"), F.substring("body", k * line + 1, line)) for k in range(HEIGHT)))
    rows = rows.select("image_id", _png16_packed(lines).alias("packed"), *_PLANES)
    both = rows.select("image_id", F.explode(F.array(*(F.unhex(F.concat(*parts)) for parts in (_png16_parts(), _psd_parts())))).alias("content"))
    found = both.select("image_id", detect.format_of(F.col("content")).alias("kind"), "content")
    size = detect.measure(F.col("content"), F.col("kind"))
    return found.select("image_id", "kind", size["width"].cast("int").alias("width"), size["height"].cast("int").alias("height"))
