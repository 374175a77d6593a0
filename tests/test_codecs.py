"""Codecs on rasters: round trips, files put together by hand, damaged files."""

import random
import struct
import zlib

import numpy as np
import pytest

from pixelframe import raster as R
from pixelframe.codecs import bmp, dds, exr, farbfeld, gif, hdr, icns, ico, jpeg, pcx, png, pnm, psd, qoi, ras, tga, tiff, xbm, xpm
from pixelframe.errors import CODES, DecodeFailed, ImageError, TooLarge
from pixelframe.functions.detect import sniff
from pixelframe.registry import Options, default_registry


def swatch(width=16, height=12, alpha=False):
    y, x = np.mgrid[:height, :width]
    out = np.stack([np.where(x < width // 2, 220, 30), np.where(y < height // 2, 200, 40), np.where((x + y) % 2, 60, 180), np.full_like(x, 255)], axis=2).astype(np.uint8)
    if alpha:
        out[:, :2, 3] = 0
        out[:, :2, :3] = 0
    return R.with_alpha(out)


def noisy(width=19, height=11, alpha=True, seed=1):
    data = np.random.default_rng(seed).integers(0, 256, (height, width, 4), dtype=np.uint8)
    if not alpha:
        data[..., 3] = 255
    return R.with_alpha(data)


LOSSLESS = ["png", "qoi", "bmp", "tga", "pnm", "farbfeld", "tiff", "ras"]


@pytest.mark.parametrize("fmt", LOSSLESS)
@pytest.mark.parametrize("image", [swatch(), swatch(alpha=True), noisy(), noisy(alpha=False), noisy(1, 1), noisy(300, 3), swatch(1, 40)], ids=["swatch", "clear", "noise", "opaque", "dot", "wide", "tall"])
def test_round_trip(fmt, image):
    registry = default_registry()
    data, _ = registry.encode(R.Decoded(image), fmt, Options())
    assert sniff(data) == fmt
    found, _ = registry.decode(data, fmt, 10**7)
    assert np.array_equal(found.image.data, image.data) and found.image.has_alpha == image.has_alpha


@pytest.mark.parametrize("fmt", ["pcx", "gif", "xpm", "ico", "icns", "xbm", "apng"])
def test_other_writers_round_trip(fmt):
    registry, image = default_registry(), swatch(alpha=fmt != "pcx")
    data, _ = registry.encode(R.Decoded(image), fmt, Options())
    assert sniff(data) == fmt
    found = registry.decode(data, fmt, 10**7)[0].image
    if fmt == "xbm":
        assert np.array_equal(found.data[..., 3] == 255, xbm.ink_of(image))
    elif fmt in ("ico", "icns"):
        assert (found.width, found.height) == (16, 16)
    else:
        assert np.array_equal(found.data, image.data)


def test_pcx_true_colour():
    image = noisy(33, 20, alpha=False)
    assert np.array_equal(pcx.decode(pcx.encode(image)).data, image.data)


def test_gif_frames_and_delays():
    frames = [R.Frame(R.opaque(np.full((8, 8, 3), c, np.uint8)), ms) for c, ms in ((200, 100), (100, 120), (10, 140))]
    found = gif.decode(gif.encode(frames, 0))
    assert [f.delay_ms for f in found.frames] == [100, 120, 140] and found.loop_count == 0
    assert all(np.array_equal(a.image.data, b.image.data) for a, b in zip(found.frames, frames, strict=True))
    again = png.decode_apng(png.encode_apng(found.frames, 3))
    assert [f.delay_ms for f in again.frames] == [100, 120, 140] and again.loop_count == 3
    assert np.array_equal(again.frames[2].image.data, frames[2].image.data)


def test_gif_many_colours_and_lzw_limits():
    image = noisy(64, 64, alpha=False)
    found = gif.decode(gif.encode([R.Frame(image, 0)], dither=False)).image
    assert np.abs(found.data.astype(int) - image.data).mean() < 12
    for n in (1, 255, 5000, 70000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        assert gif.lzw_decode(gif.lzw_encode(data, 8), 8, n) == data


def test_light_formats():
    light = R.Raster(np.abs(np.random.default_rng(3).normal(0.5, 2, (20, 24, 4))).astype(np.float32), "srgb", False)
    light.data[..., 3] = 1
    back = exr.decode(exr.encode(light))
    assert np.allclose(back.data, light.data, rtol=1e-3, atol=1e-6)
    back = hdr.decode(hdr.encode(light))
    top = light.data[..., :3].max(axis=2, keepdims=True)
    assert (np.abs(back.data[..., :3] - light.data[..., :3]) <= top / 128 + 1e-9).all()
    assert R.tone_map(light)[0].data.dtype == np.uint8


def test_tone_map_puts_grey_at_118():
    for v in (0.01, 1.0, 50.0):
        light = R.Raster(np.full((4, 4, 4), v, np.float32), "srgb", False)
        assert R.tone_map(light, clip=True)[0].data[0, 0, 0] == 118


def test_png_interlaced_and_bombs_are_refused():
    head = struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 1)
    with pytest.raises(DecodeFailed):
        png.decode(png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IEND", b""))
    head = struct.pack(">IIBBBBB", 60000, 60000, 8, 2, 0, 0, 0)
    with pytest.raises(TooLarge):
        png.decode(png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IEND", b""))
    head = struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)
    with pytest.raises(DecodeFailed):
        png.decode(png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", zlib.compress(bytes(10**6))) + png.chunk(b"IEND", b""))


def test_png_sixteen_bits_key_and_palette():
    head = struct.pack(">IIBBBBB", 2, 1, 16, 0, 0, 0, 0)
    data = png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"tRNS", b"\x12\x34") + png.chunk(b"IDAT", zlib.compress(b"\0\x12\x34\xff\xff")) + png.chunk(b"IEND", b"")
    assert png.decode(data).image.data.tolist() == [[[18, 18, 18, 0], [255, 255, 255, 255]]]
    head = struct.pack(">IIBBBBB", 3, 1, 2, 3, 0, 0, 0)
    data = png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"PLTE", bytes(range(9))) + png.chunk(b"tRNS", b"\x07") + png.chunk(b"IDAT", zlib.compress(b"\0\x1b")) + png.chunk(b"IEND", b"")
    assert png.decode(data).image.data[0].tolist() == [[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255]]


@pytest.mark.parametrize("step", [1, 3, 4])
def test_png_filters_undo(step):
    rows = np.random.default_rng(step).integers(0, 256, (9, 12), dtype=np.uint8)
    packed = np.frombuffer(png.filtered(rows, step), np.uint8).reshape(9, 13)
    assert np.array_equal(png.unfilter(packed, step), rows)


def test_bmp_palette_and_masks():
    info = struct.pack("<IiiHHIIiiII", 40, 4, -1, 1, 1, 0, 0, 0, 0, 2, 0) + bytes((0, 0, 255, 0, 0, 255, 0, 0))
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + len(info)) + info + b"\x50\0\0\0"
    assert bmp.decode(data).data[0, :, :3].tolist() == [[255, 0, 0], [0, 255, 0], [255, 0, 0], [0, 255, 0]]
    info = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 16, 3, 0, 0, 0, 0, 0) + struct.pack("<III", 0xF800, 0x7E0, 0x1F)
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + len(info)) + info + struct.pack("<HH", 0xFFE0, 0)
    assert bmp.decode(data).data[0, 0].tolist() == [255, 255, 0, 255]


def test_text_formats():
    assert pnm.decode(b"P1\n# a comment\n3 1\n1 0 1\n").data[0, :, 0].tolist() == [0, 255, 0]
    assert pnm.decode(b"P2 2 1 15 0 15").data[0, :, 0].tolist() == [0, 255]
    assert pnm.decode(b"P5 1 1 65535\n\x80\x00").data[0, 0, 0] == 128
    bits = b"#define a_width 9\n#define a_height 1\nstatic char a_bits[] = { 0x01, 0x01 };"
    assert xbm.decode(bits).data[0, :, 3].tolist() == [255] + [0] * 7 + [255]
    found = xpm.decode(b'/* XPM */ static char *x[] = { "2 1 2 1", "a c None", "b c red m black", "ab" };')
    assert found.data[0].tolist() == [[0, 0, 0, 0], [255, 0, 0, 255]]
    assert xpm.colour_of("gray50") == (128, 128, 128, 255) and xpm.colour_of("#FFF000fff") == (255, 0, 255, 255)


def test_qoi_runs_and_overlong_files():
    image = R.opaque(np.zeros((1, 200, 3), np.uint8))
    data = qoi.encode(image)
    assert np.array_equal(qoi.decode(data).data, image.data)
    with pytest.raises(DecodeFailed):
        qoi.decode(data[:-8] + b"\xc0" + data[-8:])


def tiff_of(pixels: bytes, fields: dict[int, tuple[int, list[int]]], mark="<") -> bytes:
    entries = fields | {273: (4, [8]), 279: (4, [len(pixels)])}
    body = pixels + bytes(len(pixels) % 2)
    at = 8 + len(body)
    out = struct.pack(mark + "2sHI", b"II" if mark == "<" else b"MM", 42, at) + body + struct.pack(mark + "H", len(entries))
    tail_at, tail = at + 2 + 12 * len(entries) + 4, b""
    for tag, (kind, values) in sorted(entries.items()):
        raw = struct.pack(f"{mark}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(mark + "I", tail_at + len(tail))
        tail += raw if len(raw) > 4 else b""
        out += struct.pack(mark + "HHI", tag, kind, len(values)) + place
    return out + bytes(4) + tail


@pytest.mark.parametrize("mark", ["<", ">"])
def test_tiff_kinds(mark):
    grey = {256: (4, [2]), 257: (4, [2]), 258: (3, [8]), 262: (3, [0])}
    assert tiff.decode(tiff_of(bytes((0, 255, 10, 20)), grey, mark)).image.data[..., 0].tolist() == [[255, 0], [245, 235]]
    turned = grey | {262: (3, [1]), 274: (3, [6])}
    assert tiff.decode(tiff_of(bytes((1, 2, 3, 4)), turned, mark)).image.data[..., 0].tolist() == [[3, 1], [4, 2]]
    packed = {256: (4, [8]), 257: (4, [1]), 258: (3, [1]), 262: (3, [1]), 259: (3, [32773])}
    assert tiff.decode(tiff_of(b"\0\xaa", packed, mark)).image.data[0, :, 0].tolist() == [255, 0] * 4
    cmyk = {256: (4, [1]), 257: (4, [1]), 258: (3, [8] * 4), 262: (3, [5]), 277: (3, [4])}
    assert tiff.decode(tiff_of(bytes((255, 0, 0, 0)), cmyk, mark)).image.data[0, 0].tolist() == [0, 255, 255, 255]


def fax(rows, group):
    """Rows of bits in groups 2, 3 and 4, by the plain rules."""
    from pixelframe.codecs import ccitt

    def run(n, colour):
        codes, out = (ccitt.WHITE, ccitt.BLACK)[colour], ""
        while n >= 2560:
            out, n = out + ccitt.LONG[-1], n - 2560
        if n >= 1792:
            out, n = out + ccitt.LONG[n // 64 - 28], n % 64
        elif n >= 64:
            out, n = out + codes[63 + n // 64], n % 64
        return out + codes[n]

    modes = {v: k for k, v in ccitt.MODES.items()}
    above, bits = [0] * len(rows[0]), ""
    for row in rows:
        width = len(row)
        change = lambda line, at, colour: next((i for i in range(max(at + 1, 0), width) if line[i] != (line[i - 1] if i else 0) and line[i] != colour), width)
        end = lambda line, at: next((i for i in range(at + 1, width) if line[i] != line[i - 1]), width)
        if group == 4:
            at, colour = -1, 0
            while at < width:
                a1 = next((i for i in range(max(at, 0), width) if row[i] != colour), width)
                b1 = change(above, at, colour)
                b2 = end(above, b1)
                if b2 < a1:
                    bits, at = bits + modes["pass"], b2
                elif abs(a1 - b1) <= 3:
                    bits, at, colour = bits + modes[a1 - b1], a1, colour ^ 1
                else:
                    a2 = end(row, a1)
                    bits, at = bits + modes["across"] + run(a1 - max(at, 0), colour) + run(a2 - a1, colour ^ 1), a2
        else:
            bits += "000000000001" if group == 3 else ""
            at, colour = 0, 0
            while at < width:
                stop = next((i for i in range(at, width) if row[i] != colour), width)
                bits, at, colour = bits + run(stop - at, colour), stop, colour ^ 1
            bits += "0" * (-len(bits) % 8) if group == 2 else ""
        above = row
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("group", [2, 3, 4])
def test_fax(group):
    r = random.Random(group)
    for width in (1, 9, 64, 700, 2700):
        rows, now = [], [0] * width
        for _ in range(12):
            now = list(now)
            for _ in range(r.randrange(4)):
                a = r.randrange(width)
                b = min(width, a + r.choice([1, 2, 5, 40, 2000]))
                now[a:b] = [r.randrange(2)] * (b - a)
            rows.append(now)
        fields = {256: (4, [width]), 257: (4, [12]), 258: (3, [1]), 259: (3, [group]), 262: (3, [0])}
        got = tiff.decode(tiff_of(fax(rows, group), fields)).image.data[..., 0]
        assert np.array_equal(got == 0, np.array(rows) == 1)


def test_psd_and_dds():
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 1, 2, 8, 3) + bytes(12)
    assert psd.decode(head + struct.pack(">H", 0) + bytes((1, 2, 3, 4, 5, 6))).data[0, :, :3].tolist() == [[1, 3, 5], [2, 4, 6]]
    rle = head + struct.pack(">HHHH", 1, 2, 2, 2) + bytes((255, 9)) + bytes((255, 8)) + bytes((255, 7))
    assert psd.decode(rle).data[0, :, :3].tolist() == [[9, 8, 7]] * 2
    surface = b"DDS " + struct.pack("<7I", 124, 0x1007, 4, 4, 0, 0, 0) + bytes(44) + struct.pack("<II4s5I", 32, 4, b"DXT1", 0, 0, 0, 0, 0) + bytes(20)
    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11_10_01_00)
    found = dds.decode(surface + block).data
    assert found[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]


def test_ras_runs_and_icns_planes():
    head = struct.pack(">8I", 0x59A66A95, 4, 1, 8, 0, 2, 0, 0)
    assert ras.decode(head + b"\x80\x03\x07").data[0, :, 0].tolist() == [7] * 4
    n = 16 * 16
    plane = bytes((255, 5, n - 130 + 125, 5))
    data = b"is32" + struct.pack(">I", 8 + 3 * len(plane)) + plane * 3
    assert icns.decode(b"icns" + struct.pack(">I", 8 + len(data)) + data).data[0, 0].tolist() == [5, 5, 5, 255]


def test_ico_bitmap_with_mask():
    dib = struct.pack("<IiiHHIIiiII", 40, 8, 16, 1, 24, 0, 0, 0, 0, 0, 0) + bytes((1, 2, 3)) * 64 + b"\x80\0\0\0" * 8
    data = struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", 8, 8, 0, 0, 1, 24, len(dib), 22) + dib
    assert ico.decode(data).data[0, :2].tolist() == [[3, 2, 1, 0], [3, 2, 1, 255]]


def test_jpeg_segments():
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"\1\x11\0"
    data = b"\xff\xd8" + b"\xff\xe0\0\4ab" + frame + b"\xff\xda\0\4\0\0" + b"x\xff\0y" + b"\xff\xd9"
    assert jpeg.size(data) == (40, 30)
    more = jpeg.with_metadata(data, b"II*\0rest", bytes(70000))
    assert jpeg.exif(more) == b"II*\0rest" and jpeg.icc(more) == bytes(70000) and jpeg.size(more) == (40, 30)
    assert jpeg.best_preview(b"junk" + data + b"tail") == data


def _mutations(data: bytes, seed: int):
    r = random.Random(seed)
    n = len(data)
    for k in range(60):
        b = bytearray(data)
        kind = k % 5
        if kind == 0:
            yield data[: r.randrange(n)]
        elif kind == 1:
            b[r.randrange(min(96, n))] ^= 1 << r.randrange(8)
            yield bytes(b)
        elif kind == 2:
            b[r.randrange(n)] ^= 1 << r.randrange(8)
            yield bytes(b)
        elif kind == 3:
            a = r.randrange(n)
            b[a : a + 4] = r.choice([bytes(4), b"\xff" * 4, b"\x7f\xff\xff\xff", b"\1\0\0\0"])
            yield bytes(b[:n])
        else:
            a = r.randrange(n)
            c = r.randrange(a, min(n, a + 40) + 1)
            yield data[:a] + data[a:c] * 2 + data[c:]


@pytest.mark.parametrize("fmt", default_registry().writable())
def test_damaged_files_fail_with_a_code(fmt):
    """Whatever is done to a file, it is read within the budget or refused with a code."""
    registry = default_registry()
    picture = R.Decoded(noisy(13, 9), [R.Frame(noisy(13, 9), 50), R.Frame(noisy(13, 9, seed=2), 50)] if fmt in ("gif", "apng") else [])
    data, _ = registry.encode(picture, fmt, Options())
    for bad in _mutations(data, 7):
        try:
            found, _ = registry.decode(bad, fmt, 1_000_000)
            assert found.image.width * found.image.height <= 1_000_000
        except ImageError as e:
            assert e.code in CODES


def test_farbfeld_is_fixed():
    assert farbfeld.encode(R.with_alpha(np.array([[[1, 2, 3, 4]]], np.uint8))).hex() == "6661726266656c64000000010000000101010202030304" + "04"


def test_tga_footer_and_origin():
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 1, 2, 24, 0)
    assert tga.decode(head + bytes((1, 2, 3, 4, 5, 6))).data[:, 0, :3].tolist() == [[6, 5, 4], [3, 2, 1]]
    assert tga.encode(swatch()).endswith(b"TRUEVISION-XFILE.\0")
