"""Windows bitmaps: OS/2 and Windows headers, palettes, 16, 24 and 32 bits with masks."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import check_size, masked, unpack_bits

_RGB, _FIELDS, _ALPHA_FIELDS = 0, 3, 6
_NAMES = {1: "RLE8", 2: "RLE4", 4: "JPEG", 5: "PNG"}


def decode(data: bytes) -> Raster:
    if len(data) < 26 or data[:2] != b"BM":
        raise DecodeFailed("no bitmap header")
    start, size = struct.unpack_from("<II", data, 10)
    return decode_dib(data, 14, start, size)


def decode_dib(data: bytes, at: int, start: int | None, size: int) -> Raster:
    """The bitmap whose info header is at ``at`` and whose pixels are at ``start`` (None: after the palette)."""
    if size == 12:
        width, height, planes, depth = struct.unpack_from("<HHHH", data, at + 4)
        compression, used = _RGB, 0
    elif size >= 40 and len(data) >= at + 40:
        width, height, planes, depth, compression = struct.unpack_from("<iiHHI", data, at + 4)
        used = struct.unpack_from("<I", data, at + 32)[0]
        if size == 64 and compression != _RGB:
            raise DecodeFailed("OS/2 compression is not read")
    else:
        raise DecodeFailed("the info header is of no known kind")
    if compression in _NAMES:
        raise DecodeFailed(f"{_NAMES[compression]} bitmaps are not read")
    if compression not in (_RGB, _FIELDS, _ALPHA_FIELDS) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32):
        raise DecodeFailed("the bitmap is of no known kind")
    top_down, height = height < 0, abs(height)
    check_size(width, height)
    masks = [0x7C00, 0x3E0, 0x1F, 0] if depth == 16 else [0xFF0000, 0xFF00, 0xFF, 0xFF000000]
    after = at + size
    declared = False
    if compression != _RGB:
        if depth not in (16, 32):
            raise DecodeFailed("masks are for 16 and 32 bits")
        n = 4 if compression == _ALPHA_FIELDS or size >= 56 else 3
        if len(data) < at + 40 + 4 * n:
            raise DecodeFailed("the masks are cut off")
        masks = [*struct.unpack_from(f"<{n}I", data, at + 40), *([0] if n == 3 else [])]
        declared = masks[3] != 0
        after += 0 if size >= 52 else 4 * n
    palette = None
    if depth <= 8:
        entry = 3 if size == 12 else 4
        room = ((len(data) if start is None else min(start, len(data))) - after) // entry
        n = min(1 << depth, used or (1 << depth), max(0, room)) if start is not None else min(1 << depth, used or (1 << depth))
        if n < 1 or len(data) < after + n * entry:
            raise DecodeFailed("the palette is cut off")
        palette = np.frombuffer(data, np.uint8, n * entry, after).reshape(n, entry)[:, 2::-1]
        after += n * entry
    begin = after if start is None else start
    stride = (width * depth + 31) // 32 * 4
    if len(data) < begin + stride * height:
        raise DecodeFailed("the file holds fewer pixels than it says")
    rows = np.frombuffer(data, np.uint8, stride * height, begin).reshape(height, stride)
    if not top_down:
        rows = rows[::-1]
    if palette is not None:
        index = unpack_bits(rows, depth, width)
        if index.max(initial=0) >= len(palette):
            raise DecodeFailed("a pixel is outside the palette")
        return opaque(palette[index])
    if depth == 24:
        return opaque(rows[:, : width * 3].reshape(height, width, 3)[..., ::-1])
    values = np.ascontiguousarray(rows[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4")
    zero = np.zeros(values.shape, np.uint8)
    channels = [masked(values, m) for m in masks]
    rgb = np.stack([zero if c is None else c for c in channels[:3]], axis=2)
    alpha = channels[3]
    if alpha is None or (not declared and not alpha.any()):
        return opaque(rgb)
    return with_alpha(np.concatenate([rgb, alpha[..., None]], axis=2))


def encode(image: Raster, alpha: bool | None = None) -> bytes:
    """24 bits bottom-up, or 32 bits with masks (V4 header) where alpha is wanted."""
    deep = image.has_alpha if alpha is None else alpha
    height, width = image.height, image.width
    if deep:
        body = image.data[::-1, :, [2, 1, 0, 3]].tobytes()
        info = struct.pack("<IiiHHIIiiII", 108, width, height, 1, 32, 3, len(body), 2835, 2835, 0, 0)
        info += struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    else:
        rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
        rows[:, : width * 3] = image.data[::-1, :, 2::-1].reshape(height, -1)
        body = rows.tobytes()
        info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    start = 14 + len(info)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + info + body
