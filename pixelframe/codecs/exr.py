"""OpenEXR: version 2 scan lines, uncompressed, run-length or zip."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, to_light
from .bits import Reader, check_size

_MAGIC = 20000630
_LINES = {0: 1, 1: 1, 2: 1, 3: 16}
_TYPES = {0: np.dtype("<u4"), 1: np.dtype("<f2"), 2: np.dtype("<f4")}
_P3 = (0.68, 0.32, 0.265, 0.69, 0.15, 0.06, 0.3127, 0.329)


def _name(r: Reader) -> bytes:
    end = r.data.find(b"\0", r.at, r.at + 256)
    if end < 0:
        raise DecodeFailed("a name does not end")
    out = r.data[r.at : end]
    r.at = end + 1
    return out


def _unrle(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at] - 256 if data[at] > 127 else data[at]
        if n < 0:
            out += data[at + 1 : at + 1 - n]
            at += 1 - n
        else:
            out += data[at + 1 : at + 2] * (n + 1)
            at += 2
    return bytes(out)


def _unshuffled(data: bytes) -> bytes:
    """Undoes the byte predictor and puts the two halves together again."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    b[1:] -= 128
    v = np.cumsum(b).astype(np.uint8)
    out = np.empty(len(v), np.uint8)
    half = (len(v) + 1) // 2
    out[0::2], out[1::2] = v[:half], v[half:]
    return out.tobytes()


def _shuffled(data: bytes) -> bytes:
    v = np.frombuffer(data, np.uint8)
    v = np.concatenate([v[0::2], v[1::2]]).astype(np.int64)
    out = v.copy()
    out[1:] = v[1:] - v[:-1] + 128
    return out.astype(np.uint8).tobytes()


def decode(data: bytes) -> Raster:
    """Scene light; the data window placed in the display window."""
    r = Reader(data, what="OpenEXR file")
    magic, version = r.read("II")
    if magic != _MAGIC or version & 255 != 2:
        raise DecodeFailed("no version 2 header")
    if version & 0x1A00:
        raise DecodeFailed("tiled, deep and multi-part files are not read")
    head: dict[bytes, tuple[bytes, bytes]] = {}
    while name := _name(r):
        kind = _name(r)
        head[name] = kind, r.take(r.u32())
    try:
        compression = head[b"compression"][1][0]
        data_box, display = (struct.unpack("<4i", head[k][1]) for k in (b"dataWindow", b"displayWindow"))
        c = Reader(head[b"channels"][1], what="channel list")
    except (KeyError, IndexError, struct.error):
        raise DecodeFailed("the header lacks an attribute") from None
    if compression not in _LINES:
        raise DecodeFailed("the compression is not read")
    if b"pixelAspectRatio" in head and abs(struct.unpack("<f", head[b"pixelAspectRatio"][1])[0] - 1) > 1e-3:
        raise DecodeFailed("pixels that are not square are not read")
    space = "srgb"
    if b"chromaticities" in head:
        found = struct.unpack("<8f", head[b"chromaticities"][1])
        if np.allclose(found, _P3, atol=1e-3):
            space = "display-p3"
        elif not np.allclose(found, (0.64, 0.33, 0.3, 0.6, 0.15, 0.06, 0.3127, 0.329), atol=1e-3):
            raise DecodeFailed("the primaries are not read")
    channels = []
    while name := _name(c):
        kind, _, sx, sy = c.read("iIii")
        if kind not in _TYPES or (sx, sy) != (1, 1):
            raise DecodeFailed("a channel is of no known kind")
        channels.append((name, _TYPES[kind]))
    names = {n for n, _ in channels}
    if not ({b"R", b"G", b"B"} <= names or b"Y" in names):
        raise DecodeFailed("there are no colour channels")
    width, height = data_box[2] - data_box[0] + 1, data_box[3] - data_box[1] + 1
    full_width, full_height = display[2] - display[0] + 1, display[3] - display[1] + 1
    check_size(width, height, 100_000_000)
    check_size(full_width, full_height, 100_000_000)
    lines = _LINES[compression]
    blocks = -(-height // lines)
    offsets = r.read(f"{blocks}Q")
    planes = {n: np.zeros((height, width), np.float32) for n, _ in channels}
    for offset in offsets:
        r.at = offset
        y, size = r.read("iI")
        y -= data_box[1]
        if not 0 <= y < height:
            raise DecodeFailed("a block lies outside the data window")
        n = min(lines, height - y)
        wanted = n * width * sum(t.itemsize for _, t in channels)
        packed = r.take(size)
        if compression and size < wanted:
            try:
                packed = _unshuffled(_unrle(packed, wanted) if compression == 1 else zlib.decompressobj().decompress(packed, wanted + 1))
            except zlib.error:
                raise DecodeFailed("a block does not inflate") from None
        if len(packed) != wanted:
            raise DecodeFailed("a block has another size than its lines")
        at = 0
        for line in range(n):
            for name, kind in channels:
                planes[name][y + line] = np.frombuffer(packed, kind, width, at).astype(np.float32)
                at += width * kind.itemsize
    out = np.zeros((full_height, full_width, 4), np.float32)
    has_alpha = b"A" in names
    if not has_alpha:
        out[..., 3] = 1
    x0, y0 = data_box[0] - display[0], data_box[1] - display[1]
    a, b = slice(max(0, y0), max(0, min(full_height, y0 + height))), slice(max(0, x0), max(0, min(full_width, x0 + width)))
    part = (slice(a.start - y0, a.stop - y0), slice(b.start - x0, b.stop - x0))
    for i, name in enumerate((b"R", b"G", b"B")):
        plane = planes.get(name, planes.get(b"Y"))
        top = np.finfo(np.float32).max
        out[a, b, i] = np.clip(np.nan_to_num(plane[part], nan=0.0, posinf=top, neginf=0.0), -top, top)
    if has_alpha:
        out[a, b, 3] = np.clip(np.nan_to_num(planes[b"A"][part], nan=1.0, posinf=1.0, neginf=1.0), 0, 1)
    return Raster(out, space, has_alpha and bool((out[..., 3] < 1).any()))


def _attribute(name: str, kind: str, body: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<I", len(body)) + body


def encode(image: Raster) -> bytes:
    """Half floats in zip blocks of sixteen lines; a block that does not shrink is stored as it is."""
    light = image if image.is_light else to_light(image)
    names = "ABGR" if image.has_alpha else "BGR"
    box = struct.pack("<4i", 0, 0, image.width - 1, image.height - 1)
    listed = b"".join(n.encode() + b"\0" + struct.pack("<iIii", 1, 0, 1, 1) for n in names) + b"\0"
    head = struct.pack("<II", _MAGIC, 2) + _attribute("channels", "chlist", listed)
    if image.colour_space == "display-p3":
        head += _attribute("chromaticities", "chromaticities", struct.pack("<8f", *_P3))
    head += _attribute("compression", "compression", b"\3") + _attribute("dataWindow", "box2i", box) + _attribute("displayWindow", "box2i", box)
    head += _attribute("lineOrder", "lineOrder", b"\0") + _attribute("pixelAspectRatio", "float", struct.pack("<f", 1))
    head += _attribute("screenWindowCenter", "v2f", bytes(8)) + _attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    with np.errstate(over="ignore"):
        half = light.data.astype("<f2")
    order = ["RGBA".index(n) for n in names]
    body, offsets = bytearray(), []
    start = len(head) + 8 * -(-image.height // 16)
    for y in range(0, image.height, 16):
        raw = np.ascontiguousarray(np.moveaxis(half[y : y + 16][..., order], 2, 1)).tobytes()
        packed = zlib.compress(_shuffled(raw), 6)
        packed = packed if len(packed) < len(raw) else raw
        offsets.append(start + len(body))
        body += struct.pack("<iI", y, len(packed)) + packed
    return head + struct.pack(f"<{len(offsets)}Q", *offsets) + bytes(body)
