"""Boxes, HEIF, AVIF, WebP and the table functions."""

import struct

import numpy as np
import pytest

from pixelframe import raster as R
from pixelframe.codecs import icns, ico, png, tiff
from pixelframe.containers import avif, heif, webp
from pixelframe.containers.boxes import box, find, full_box, walk
from pixelframe.errors import HeifMalformed, HeifUnsupported
from pixelframe.functions import tables
from pixelframe.functions.detect import sniff


def heic(columns=2, rows=2, tile=8, width=14, height=12, degrees=0, axis=None, alpha=False, tiles=None, kind=b"hvc1"):
    """A file whose tile k holds the one byte k."""
    n = columns * rows if tiles is None else tiles
    grid = bytes((0, 0, rows - 1, columns - 1)) + struct.pack(">HH", width, height)
    payloads = [grid] + [bytes((k,)) for k in range(n)] + ([bytes((99,))] if alpha else [])
    infos = [(1, b"grid")] + [(2 + k, kind) for k in range(n)] + ([(2 + n, kind)] if alpha else [])
    ispe = lambda w, h: full_box("ispe", 0, 0, struct.pack(">II", w, h))
    config = bytes((1, 0x61, 0x60, 0, 0, 0, 0x90, 0, 0, 0, 0, 0, 93)) + bytes(10)
    properties = [ispe(width, height), ispe(tile, tile), box("hvcC", config), box("irot", bytes((degrees // 90,))), box("imir", bytes((int(axis == "horizontal"),)))]
    properties += [full_box("auxC", 0, 0, b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0"), box("colr", b"nclx" + struct.pack(">HHHB", 12, 13, 1, 128))]
    own = [(1, [1, 7, *([4] if degrees else []), *([5] if axis else [])])] + [(2 + k, [2, 3]) for k in range(n)] + ([(2 + n, [1, 3, 6])] if alpha else [])
    refs = box("dimg", struct.pack(f">HH{n}H", 1, n, *range(2, 2 + n))) + (box("auxl", struct.pack(">HHH", 2 + n, 1, 1)) if alpha else b"")

    def meta(at):
        places = b""
        for i, p in enumerate(payloads):
            places += struct.pack(">HHHII", i + 1, 0, 1, at, len(p))
            at += len(p)
        entries = b"".join(full_box("infe", 2, 0, struct.pack(">HH", i, 0) + t + b"\0") for i, t in infos)
        owners = b"".join(struct.pack(">HB", i, len(p)) + bytes(p) for i, p in own)
        return full_box("meta", 0, 0, full_box("pitm", 0, 0, b"\0\1"), full_box("iinf", 0, 0, struct.pack(">H", len(infos)) + entries), full_box("iloc", 0, 0, struct.pack(">HH", 0x4400, len(payloads)) + places), full_box("iref", 0, 0, refs), box("iprp", box("ipco", *properties), full_box("ipma", 0, 0, struct.pack(">I", len(own)) + owners)))

    head = box("ftyp", b"heic", bytes(4), b"mif1heic")
    return head + meta(len(head) + len(meta(0)) + 8) + box("mdat", *payloads)


def fake(config, data, width, height):
    return R.opaque(np.full((height, width, 3), 40 * data[0] % 256, np.uint8))


def test_grid():
    image, gain, dropped = heif.decode(heic(), fake)
    assert sniff(heic()) == "heic" and (image.width, image.height, image.colour_space) == (14, 12, "display-p3")
    assert image.data[0, 0, 0] == 0 and image.data[0, 8, 0] == 40 and image.data[8, 0, 0] == 80 and image.data[11, 13, 0] == 120
    assert gain is None and not dropped and not image.has_alpha


def test_turned_and_mirrored():
    image, *_ = heif.decode(heic(degrees=90, axis="horizontal"), fake)
    plain, *_ = heif.decode(heic(), fake)
    assert np.array_equal(image.data, R.rotate(R.mirror(plain, "horizontal"), 90).data)


def test_alpha_plane_and_its_loss():
    image, _, dropped = heif.decode(heic(alpha=True), fake)
    assert image.has_alpha and (image.data[..., 3] == 99 * 40 % 256).all() and not dropped

    def picky(config, data, width, height):
        if data[0] == 99:
            raise HeifUnsupported("no alpha here")
        return fake(config, data, width, height)

    image, _, dropped = heif.decode(heic(alpha=True), picky)
    assert dropped and not image.has_alpha


def test_refusals():
    with pytest.raises(HeifMalformed):
        heif.plan(heic(width=40))
    with pytest.raises(HeifMalformed):
        heif.plan(heic(tiles=3))
    with pytest.raises(HeifUnsupported):
        heif.plan(heic(kind=b"av01"))
    data = heic()
    for n in range(0, len(data) - 5, 17):
        with pytest.raises((HeifMalformed, HeifUnsupported)):
            heif.decode(data[:n], fake)


def test_codec_strings():
    assert heif.hevc_codec_string(bytes((1, 0x01, 0x60, 0, 0, 0, 0xB0, 0, 0, 0, 0, 0, 93))) == "hvc1.1.6.L93.B0"
    assert avif.rate_for(1000, 1000, 1.0) == (0, 2_000_000) and avif.rate_for(10, 10) == (25, 100_000)


def bits(*fields):
    value, n = 0, 0
    for v, w in fields:
        value, n = value << w | v, n + w
    pad = -n % 8
    return (value << pad).to_bytes((n + pad) // 8, "big")


def frame(width=16, height=12, mono=0):
    """A reduced still-picture sequence header and a frame unit."""
    head = bits((0, 3), (1, 1), (1, 1), (8, 5), (7, 4), (7, 4), (width - 1, 8), (height - 1, 8), (0, 3), (0, 3), (0, 1), (mono, 1), (0, 1), *([(1, 1)] if mono else [(1, 1), (0, 2)]), (0, 1), (0, 1), (1, 1))
    unit = lambda kind, body: bytes((kind << 3 | 2, len(body))) + body
    return unit(2, b"") + unit(1, head) + unit(6, b"picture")


def test_avif():
    data = avif.mux(16, 12, frame(), frame(mono=1), b"II*\0exif")
    assert sniff(data) == "avif"
    meta = heif.parse(data)
    assert [i.type for i in meta.items.values()] == ["av01", "av01", "Exif"] and meta.sources("auxl", 1) == [2] and meta.sources("cdsc", 1) == [3]
    assert meta.of(1, "ispe") == {"width": 16, "height": 12} and meta.bytes_of(1).endswith(b"picture") and meta.bytes_of(3) == bytes(4) + b"II*\0exif"
    s = avif.sequence_header(avif.obus(frame())[1].body)
    assert (s.width, s.height, s.mono) == (16, 12, False) and avif.codec_string(s) == "av01.0.08M.08"


def test_webp():
    still = b"RIFF\0\0\0\0WEBP" + webp.chunk(b"VP8L", b"\x2f\0\0\0\x10odd")
    data = webp.mux(4, 4, [(still, 100), (still, 1e9)], 3)
    assert sniff(data) == "webp"
    parts = dict(webp.riff_chunks(data))
    assert parts[b"VP8X"][0] == 18 and struct.unpack("<H", parts[b"ANIM"][4:]) == (3,)
    assert [int.from_bytes(b[12:15], "little") for k, b in webp.riff_chunks(data) if k == b"ANMF"] == [100, (1 << 24) - 1]


def test_boxes():
    data = box("free", b"abc") + struct.pack(">I4sQ", 1, b"wide", 18) + b"xy" + struct.pack(">I4s", 0, b"last") + b"rest"
    assert [(b.type, b.end - b.body) for b in walk(data)] == [("free", 3), ("wide", 2), ("last", 4)] and find(data, "none") is None
    with pytest.raises(HeifMalformed):
        list(walk(struct.pack(">I4s", 100, b"long")))


def test_table_functions(spark):
    tables.register_all(spark)
    image = R.opaque(np.zeros((32, 32, 3), np.uint8))
    files = {"p": png.encode(image), "i": ico.encode(image), "n": icns.encode(image), "t": tiff.encode(image), "h": heic(), "x": b"junk"}
    spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, content binary").createOrReplaceTempView("files")
    rows = lambda f, k: spark.sql(f"SELECT t.* FROM files, LATERAL {f}(content) t WHERE k = '{k}'").collect()
    assert [r.type for r in rows("png_chunks", "p")][0] == "IHDR" and not rows("png_chunks", "x")
    assert [r.width for r in rows("ico_entries", "i")] == [32, 16] and len(rows("icns_entries", "n")) == 3
    assert 256 in {r.tag for r in rows("tiff_tags", "t")} and {r.type for r in rows("iso_boxes", "h")} == {"ftyp", "meta", "mdat"}
    assert len(rows("heif_tiles", "h")) == 4 and {r.ref_type for r in rows("heif_references", "h")} == {"dimg"} and len(rows("heif_items", "h")) == 5


def test_heif_of_jpeg_tiles_is_read_by_default():
    """A grid of two coded tiles, cut to size and turned; a tile that is not JPEG is unsupported."""
    import numpy as np

    from pixelframe.codecs import jpeg_pixels
    from pixelframe.containers import heif
    from pixelframe.errors import ImageError
    from pixelframe.raster import opaque
    from pixelframe.registry import capabilities, default_registry, jpeg_tile

    left, right = (opaque(np.full((16, 16, 3), c, np.uint8)) for c in ((200, 20, 40), (10, 30, 220)))
    tiles = {1: jpeg_pixels.encode(left, 95), 2: jpeg_pixels.encode(right, 95)}

    class Meta:
        def bytes_of(self, item):
            return tiles[item]

    plan = heif.Plan(30, 16, [heif.Tile(0, 0, 16, 16, 1), heif.Tile(16, 0, 16, 16, 2)], b"", "srgb", 90, None)
    image = heif.assemble(Meta(), plan, jpeg_tile)
    assert (image.width, image.height) == (16, 30)
    assert np.abs(image.data[-1, 0, :3].astype(int) - (200, 20, 40)).max() < 6 and np.abs(image.data[0, 0, :3].astype(int) - (10, 30, 220)).max() < 6
    with pytest.raises(ImageError):
        jpeg_tile(b"", b"\0\0\0\1hevc", 16, 16)
    found = capabilities(default_registry())
    assert {"heic", "raw", "jpeg"} <= set(found.readable) and "heic" not in found.writable and found.light_in == ("exr", "hdr") and {"gif", "apng"} <= set(found.animated)


def test_frames_after_the_most_are_left_out_and_counted():
    import numpy as np

    from pixelframe.plans.convert import Settings, convert_bytes
    from pixelframe.raster import Decoded, Frame, opaque
    from pixelframe.registry import Options, default_registry

    registry = default_registry()
    frames = [Frame(opaque(np.full((4, 5, 3), 40 * k, np.uint8)), 100.0) for k in range(5)]
    gif, _ = registry.encode(Decoded(frames[0].image, frames), "gif", Options())
    made, report = convert_bytes(gif, Settings(to="apng", most_frames=3), registry)
    assert report["frames_truncated"] == 2 and report["frames_kept"] == 3 and len(registry.decode(made, "apng", 10**6)[0].frames) == 3
    assert convert_bytes(gif, Settings(to="apng"), registry)[1]["frames_truncated"] == 0
