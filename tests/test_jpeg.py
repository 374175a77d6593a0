"""JPEG pixels against the JVM's own reader and writer."""

import struct

import numpy as np
import pytest

from pixelframe.codecs import jpeg, jpeg_pixels as j
from pixelframe.errors import DecodeFailed, ImageError
from pixelframe.functions.exif import declares_wide_gamut, icc_of
from pixelframe.plans.convert import Settings, convert_bytes
from pixelframe.raster import ORIENTATIONS, opaque, orient
from pixelframe.registry import Options, default_registry


def picture(height, width, seed=0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    rgb = np.stack([y * 255 / max(1, height - 1), x * 255 / max(1, width - 1), (3 * x + 2 * y) % 256], axis=2) + r.normal(0, 5, (height, width, 3))
    return opaque(np.clip(rgb, 0, 255).astype(np.uint8))


def rewritten(spark, data, progressive, quality=0.8, grey=False):
    """``data`` read and written again by the JVM: half the colour resolution, perhaps in many scans."""
    jvm = spark._jvm
    io = jvm.javax.imageio.ImageIO
    image = io.read(jvm.java.io.ByteArrayInputStream(data))
    if grey:
        plain = jvm.java.awt.image.BufferedImage(image.getWidth(), image.getHeight(), 10)
        plain.getGraphics().drawImage(image, 0, 0, None)
        image = plain
    writer = io.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(1)
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = io.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    return bytes(out.toByteArray())


def seen_by_jvm(spark, files, tmp_path):
    for name, data in files.items():
        (tmp_path / f"{name}.jpg").write_bytes(data)
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    return {r.origin.split("/")[-1][:-4]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., ::-1].astype(int) for r in rows}


def test_pixels_are_those_of_the_image_source(spark, tmp_path):
    files = {}
    for n, (h, w) in enumerate(((64, 48), (33, 17), (100, 131), (8, 8), (1, 3))):
        own = j.encode(picture(h, w, n))
        files |= {f"{n}own": own, f"{n}base": rewritten(spark, own, False), f"{n}many": rewritten(spark, own, True), f"{n}grey": rewritten(spark, own, True, 0.5, True)}
    kinds = set()
    for name, want in seen_by_jvm(spark, files, tmp_path).items():
        read = j.Reader(files[name]).read()
        kinds.add((read.progressive, tuple((c.h, c.v) for c in read.parts)))
        off = np.abs(read.rgb().astype(int) - want)
        assert off.max() <= 4 and off.mean() < 0.2, name
    assert (True, ((2, 2), (1, 1), (1, 1))) in kinds and (False, ((1, 1),) * 3) in kinds and any(len(c) == 1 for _, c in kinds)


@pytest.mark.parametrize("quality", [1, 50, 92, 100])
def test_round_trip_by_quality(quality):
    image = picture(40, 57)
    off = np.abs(j.decode(j.encode(image, quality)).image.data.astype(int) - image.data)
    assert off[..., :3].mean() < {1: 60, 50: 9, 92: 5, 100: 1}[quality]
    with pytest.raises(ValueError):
        j.encode(image, 0)


def test_restart_marks():
    """The same bits with a mark after every row of units; each run begins with fresh predictions."""
    image = picture(24, 24)
    rows = [j.encode(opaque(np.ascontiguousarray(image.data[y : y + 8, :, :3])), 90) for y in (0, 8, 16)]
    tables = {r[r.find(b"\xff\xc4") : r.find(b"\xff\xda")] for r in rows}
    whole = j.encode(image, 90)
    assert len(tables) == 3 and j.Reader(whole).read().interval == 0
    # A picture of one colour has the same tables in every row.
    flat = opaque(np.full((24, 24, 3), (200, 30, 90), np.uint8))
    one = j.encode(opaque(np.ascontiguousarray(flat.data[:8, :, :3])), 90)
    head, scan = one[: one.find(b"\xff\xda")], one[one.find(b"\xff\xda") :]
    bits = scan[14:-2]
    size = head.find(b"\xff\xc0") + 5
    made = head[:size] + struct.pack(">H", 24) + head[size + 2 :] + b"\xff\xdd\x00\x04" + struct.pack(">H", 3) + scan[:14] + bits + b"\xff\xd0" + bits + b"\xff\xd1" + bits + b"\xff\xd9"
    assert np.abs(j.decode(made).image.data.astype(int) - flat.data).max() <= 2


def test_damage_is_an_error_and_no_crash(spark):
    whole = rewritten(spark, j.encode(picture(30, 30)), True)
    r = np.random.default_rng(1)
    once = rewritten(spark, j.encode(picture(30, 30)), False)
    for n in range(2, len(once) - 20, 37):  # cut off in the one scan or before it
        with pytest.raises((ImageError, struct.error, IndexError)):
            j.decode(once[:n])
    registry = default_registry()
    for _ in range(150):
        data = bytearray(whole)
        for at in r.integers(2, len(data), 3):
            data[at] = int(r.integers(0, 256))
        try:
            registry.decode(bytes(data), "jpeg", 10**7)
        except ImageError:
            pass
    with pytest.raises(DecodeFailed):
        j.decode(b"\xff\xd8\xff\xd9")


def exif(orientation):
    return b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0" + bytes((orientation, 0, 0, 0)) + bytes(4)


@pytest.mark.parametrize("value", list(ORIENTATIONS))
def test_pictures_are_upright_and_metadata_is_carried(value):
    image = picture(24, 16)
    data = j.encode(image, 95, exif(value), b"p" * 200)
    plain = j.decode(j.encode(image, 95)).image
    found = j.decode(data)
    assert np.array_equal(found.image.data, orient(plain, value).data) and found.icc == b"p" * 200
    made, report = convert_bytes(data, Settings(to="jpeg", metadata="preserve"), default_registry())
    assert report["exif_kept"] and report["icc_kept"] and report["decoder"] == "jpeg-pure"
    assert jpeg.exif(made) == exif(1) and jpeg.icc(made) == b"p" * 200
    stripped, _ = convert_bytes(data, Settings(to="jpeg"), default_registry())
    assert jpeg.exif(stripped) is None and jpeg.icc(stripped) is None


def test_previews_are_decoded():
    image, registry = picture(32, 48), default_registry()
    small, large = j.encode(picture(8, 8)), j.encode(image)
    for head, fmt in ((b"FUJIFILMCCD-RAW " + bytes(84), "raw"), (b"II*\0" + bytes(60), "tiff")):
        found, codec = registry.decode(head + small + bytes(31) + large + bytes(9), fmt, 10**7)
        assert codec.id == f"{fmt}-preview" and np.array_equal(found.image.data, j.decode(large).image.data)


def test_quality_is_an_option_and_alpha_is_flattened():
    image = picture(32, 32)
    image.data[..., 3], image.has_alpha = 0, True
    from pixelframe.raster import Decoded

    registry = default_registry()
    sizes = [len(registry.encode(Decoded(image), "jpeg", Options(quality=q))[0]) for q in (20, 95)]
    made, _ = registry.encode(Decoded(image), "jpeg", Options(background=(10, 200, 30)))
    assert np.abs(j.decode(made).image.data[..., :3].astype(int) - (10, 200, 30)).max() <= 3 and sizes[0] <= sizes[1]


def wide_profile():
    """A profile of nothing but Display P3's colourants."""
    values = {b"rXYZ": (0.51512, 0.2412, -0.00105), b"gXYZ": (0.29198, 0.69225, 0.04189), b"bXYZ": (0.1571, 0.06657, 0.78407)}
    table, body = b"", b""
    for tag, v in values.items():
        table += struct.pack(">4sII", tag, 132 + 36 + len(body), 20)
        body += b"XYZ " + bytes(4) + struct.pack(">3i", *(round(x * 65536) for x in v))
    return bytes(128) + struct.pack(">I", 3) + table + body


def test_wide_gamut_is_declared_by_every_carrier():
    import zlib

    from pixelframe.codecs import png

    profile, image = wide_profile(), picture(9, 9)
    data = j.encode(image, 90, None, profile)
    assert j.decode(data).image.colour_space == "display-p3" and declares_wide_gamut(data, "jpeg") and icc_of(data, "jpeg") == profile
    riff = b"ICCP" + struct.pack("<I", len(profile)) + profile + b"\0" * (len(profile) % 2)
    webp = b"RIFF" + struct.pack("<I", len(riff) + 4) + b"WEBP" + riff
    assert declares_wide_gamut(webp, "webp") and not declares_wide_gamut(webp[:40], "webp")
    plain = png.encode(image, None, True, None, None)
    body = b"x\0\0" + zlib.compress(profile)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    assert declares_wide_gamut(plain[:33] + chunk(b"iCCP", body) + plain[33:], "png") and not declares_wide_gamut(plain, "png")
    assert declares_wide_gamut(plain[:33] + chunk(b"cICP", bytes((12, 13, 0, 1))) + plain[33:], "png")
    made, report = convert_bytes(data, Settings(to="bmp"), default_registry())
    assert report["narrowed"] and report["colour_space"] == "srgb"
