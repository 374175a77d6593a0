"""Detection, conversion, registry, metadata, files and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe import raster as R
from pixelframe.codecs import exr, gif, png, qoi, tiff
from pixelframe.errors import DecodeFailed, TooLarge, UnsupportedHere
from pixelframe.formats import FORMATS, format_for_extension, format_for_mime, formats_table
from pixelframe.functions import detect, exif, naming
from pixelframe.plans.convert import Settings, convert, convert_bytes, summary
from pixelframe.registry import Decoder, Options, default_registry
from pixelframe.sources import images as S
from pixelframe.streaming.convert import convert_stream


def square(n=8, alpha=False):
    data = np.random.default_rng(n).integers(0, 256, (n, n, 4), dtype=np.uint8)
    if not alpha:
        data[..., 3] = 255
    return R.with_alpha(data)


def box(*brands):
    return struct.pack(">I4s", 8 + 4 * len(brands) + 4, b"ftyp") + brands[0] + bytes(4) + b"".join(brands[1:])


def directory(*tags):
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)


SAMPLES = {
    "jpeg": b"\xff\xd8\xff\xe0", "jxl": b"\xff\x0a", "webp": b"RIFF\0\0\0\0WEBP", "avif": box(b"mif1", b"heic", b"avif"), "heic": box(b"heic", b"mif1"), "raw": directory((0xC612, 1, 4, 1)),
    "tiff": directory((256, 3, 1, 4)), "svg": b"\xef\xbb\xbf  <?xml version='1.0'?>", "psd": b"8BPS\0\1", "dds": b"DDS ", "ico": b"\0\0\2\0\1\0", "pnm": b"P6\n1 1", "hdr": b"#?RGBE\n",
    "xpm": b"/* XPM */", "xbm": b"#define x_width 3", "exr": b"\x76\x2f\x31\x01", "icns": b"icns", "bmp": b"BM", "gif": b"GIF89a", "qoi": b"qoif", "ras": b"\x59\xa6\x6a\x95", "farbfeld": b"farbfeld",
}
MORE = [directory((0xFE, 4, 1, 1), (0x14A, 4, 1, 99)), b"II+\0", b"MM\0*" + bytes(4), b"IIRO", b"\0\0\0\x0cJXL \r\n\x87\n", box(b"jxl ", b"jxl "), box(b"crx ", b"isom"), b"", b"hello", b"P8\n", b"#define height", b"\0\0\1\0\0\0", b"<html>"]


def test_detection_as_a_column_agrees(spark):
    files = [*SAMPLES.values(), *MORE]
    registry = default_registry()
    files += [registry.encode(R.Decoded(square()), f, Options())[0] for f in registry.writable()]
    files += [f[:n] for f in files for n in (1, 3, 8, 17, 30)]
    rows = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "i int, content binary")
    got = {r.i: r.fmt for r in rows.select("i", detect.format_of(F.col("content")).alias("fmt")).collect()}
    assert got == {i: detect.sniff(f) for i, f in enumerate(files)}
    for name, data in SAMPLES.items():
        assert detect.sniff(data) == name


def test_formats():
    assert len(FORMATS) == 26
    assert format_for_mime("IMAGE/JPG; q=1") == "jpeg" and format_for_mime("text/html") is None
    assert format_for_extension("a.b.TIFF") == "tiff" and format_for_extension("noext") is None


def test_formats_table(spark):
    assert formats_table(spark).where("displayable").count() == 9


def test_names(spark):
    names = ["a/b.c.jpg", ".hidden", "../../x", "", "...", "plain", " sp .png "]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(naming.output_name(F.col("n"), "png")).collect()
    assert [r[0] for r in rows] == ["ab.c.png", ".hidden.png", "image.png", "image.png", "image.png", "plain.png", "sp .png"]


def files_of(spark, rows):
    return spark.createDataFrame([(p, None if b is None else bytearray(b)) for p, b in rows], "path string, content binary")


def test_convert_rows_fail_alone(spark):
    huge = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 50000, 50000, 8, 2, 0, 0, 0)) + png.chunk(b"IEND", b"")
    rows = [("ok", png.encode(square(alpha=True))), ("null", None), ("empty", b""), ("text", b"hello"), ("huge", huge), ("cut", png.encode(square())[:60]), ("heic", SAMPLES["heic"])]
    got = {r.path: r for r in convert(files_of(spark, rows), Settings(to="qoi")).collect()}
    assert got["ok"].ok and np.array_equal(qoi.decode(bytes(got["ok"].content)).data, square(alpha=True).data)
    codes = {k: r.error_code for k, r in got.items() if not r.ok}
    assert codes == {"null": "input/empty", "empty": "input/empty", "text": "input/unknown-format", "huge": "input/too-large", "cut": "decode/failed", "heic": "heif/malformed"}
    assert summary(convert(files_of(spark, rows), Settings(to="qoi"))).where("ok").first().n_files == 1


def test_convert_policies():
    registry = default_registry()
    content, report = convert_bytes(png.encode(square(16, alpha=True)), Settings(to="pcx", longest_side=8), registry)
    assert report["flattened"] and report["resized"] and (report["target_width"], report["encoder"]) == (8, "pcx-pure")
    p3 = R.Raster(square().data, "display-p3", False)
    assert convert_bytes(png.encode(p3), Settings(to="qoi"), registry)[1]["narrowed"]
    assert not convert_bytes(png.encode(p3), Settings(to="png"), registry)[1]["narrowed"]
    light = R.Raster(np.full((4, 4, 4), 3, np.float32), "srgb", False)
    assert convert_bytes(exr.encode(light), Settings(to="png"), registry)[1]["tone_mapped"]
    assert not convert_bytes(exr.encode(light), Settings(to="hdr"), registry)[1]["tone_mapped"]
    moving = gif.encode([R.Frame(square(), 100), R.Frame(square(9).__class__(square().data[::-1], "srgb", False), 100)], 0)
    assert convert_bytes(moving, Settings(to="apng"), registry)[1]["frames_kept"] == 2
    assert convert_bytes(moving, Settings(to="apng", frames="first"), registry)[1]["frames_kept"] == 1
    assert convert_bytes(moving, Settings(to="png"), registry)[1]["frames_kept"] == 1
    with pytest.raises(TooLarge):
        convert_bytes(qoi.encode(square()), Settings(most_pixels=10), registry)


def test_ladder():
    registry = default_registry()
    calls = []

    def broken(data):
        calls.append("broken")
        raise DecodeFailed("no")

    registry.register(Decoder("first", "webp", broken, priority=1))
    registry.register(Decoder("second", "webp", lambda d: square(), priority=2))
    registry.register(Decoder("absent", "webp", broken, priority=0, available=lambda: 1 / 0))
    _, codec = registry.decode(b"", "webp", 10**6)
    assert codec.id == "second" and calls == ["broken"]
    registry.unregister("second")
    with pytest.raises(DecodeFailed):
        registry.decode(b"", "webp", 10**6)
    registry.unregister("first")
    with pytest.raises(UnsupportedHere):
        registry.decode(b"", "webp", 10**6)


def test_exif_and_profiles():
    text = b"Maker\0"
    payload = b"II*\0" + struct.pack("<IH", 8, 3) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x010F, 2, 6, 50) + struct.pack("<HHII", 0x8825, 4, 1, 56) + bytes(4) + text + struct.pack("<H", 0)
    found = exif.summary(payload)
    assert (found.orientation, found.camera_make, found.has_location, found.tag_count) == (6, "Maker", True, 3)
    assert exif.summary(exif.upright(payload)).orientation == 1
    data = png.encode(square(), exif=payload)
    assert exif.payload_of(data, "png") == payload
    _, report = convert_bytes(data, Settings(to="png", metadata="preserve"), default_registry())
    assert report["had_exif"] and report["exif_kept"]
    for mark in "<>":
        exif_at = 8 + 2 + 24 + 4
        own = struct.pack(mark + "H", 2) + struct.pack(mark + "HHII", 0x829A, 5, 1, exif_at + 30) + struct.pack(mark + "HHII", 0x927C, 7, 4, 0) + bytes(4) + struct.pack(mark + "II", 1, 250)
        top = struct.pack(mark + "H", 2) + struct.pack(mark + "HHI", 0x0110, 2, 3) + b"Cam\0" + struct.pack(mark + "HHII", 0x8769, 4, 1, exif_at) + bytes(4)
        shot = (b"II*\0" if mark == "<" else b"MM\0*") + struct.pack(mark + "I", 8) + top + own
        made = tiff.encode(square(), exif=shot)
        assert np.array_equal(tiff.decode(made).image.data, square().data)
        kept = exif.summary(made)
        assert kept.camera_model == "Cam"
        below = tiff.Directory(made, tiff.page_of(made).one(0x8769, 0), "<")
        assert below.values(0x829A) == [1 / 250] and 0x927C not in below.fields
    icc = bytes(128) + struct.pack(">I", 3) + b"".join(struct.pack(">4sII", t, 168 + 20 * i, 20) for i, t in enumerate((b"rXYZ", b"gXYZ", b"bXYZ")))
    icc += b"".join(bytes(8) + struct.pack(">3i", *(int(v * 65536) for v in xyz)) for xyz in ((0.5151, 0.2412, -0.001), (0.292, 0.6922, 0.0419), (0.1571, 0.0666, 0.7841)))
    assert exif.is_wide_gamut(icc) and not exif.is_wide_gamut(icc[:150])
    assert tiff.decode(tiff.encode(square(), icc=icc)).icc == icc


def test_files_and_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n in (3, 4):
        (source / f"p{n}.png").write_bytes(png.encode(square(n)))
    files = S.with_format(S.read_files(spark, str(source), "*.png"))
    assert {r.format for r in files.collect()} == {"png"}
    names = sorted(r.output_name for r in S.write_files(convert(files, Settings(to="bmp")), str(out)).collect())
    assert names == ["p3.bmp", "p4.bmp"] and sorted(p.name for p in out.iterdir()) == names
    assert S.decode(files).where("error_code is null").count() == 2
    query = convert_stream(spark, str(source), str(tmp_path / "table"), str(tmp_path / "log"), Settings(to="qoi"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "table")).where("ok").count() == 2
