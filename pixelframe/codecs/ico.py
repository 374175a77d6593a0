"""Windows icons and cursors."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..errors import DecodeFailed, EncodeFailed
from ..raster import Raster, fit_square, with_alpha
from . import png
from .bits import check_size, masked, unpack_bits

SIDES = (256, 128, 64, 48, 32, 16)


@dataclass(frozen=True)
class Entry:
    width: int
    height: int
    bits: int
    offset: int
    size: int
    is_png: bool


def directory(data: bytes) -> list[Entry]:
    if len(data) < 6:
        raise DecodeFailed("no icon header")
    zero, kind, n = struct.unpack_from("<HHH", data)
    if zero or kind not in (1, 2) or not n or len(data) < 6 + 16 * n:
        raise DecodeFailed("no icon header")
    out = []
    for i in range(n):
        w, h, _, _, _, bits, size, offset = struct.unpack_from("<BBBBHHII", data, 6 + 16 * i)
        body = data[offset : offset + size]
        if offset + size > len(data) or len(body) < 8:
            raise DecodeFailed("an entry lies outside the file")
        is_png = body.startswith(png.SIGNATURE)
        if is_png and len(body) >= 24:
            w, h = struct.unpack_from(">II", body, 16)
        out.append(Entry(w or 256, h or 256, bits if kind == 1 else 0, offset, size, is_png))
    return out


def decode(data: bytes) -> Raster:
    """The entry of the largest area, then of the most bits."""
    best = max(directory(data), key=lambda e: (e.width * e.height, e.bits))
    body = data[best.offset : best.offset + best.size]
    return png.decode(body).image if best.is_png else _dib(body, best.height)


def _dib(data: bytes, stated: int) -> Raster:
    """A bitmap without file header whose height counts the mask too."""
    if len(data) < 40:
        raise DecodeFailed("the bitmap is cut off")
    size, width, height, _, depth, compression = struct.unpack_from("<IiiHHI", data)
    used = struct.unpack_from("<I", data, 32)[0]
    if size < 40 or depth not in (1, 4, 8, 16, 24, 32) or compression not in (0, 3):
        raise DecodeFailed("the bitmap is of no known kind")
    top_down, height = height < 0, abs(height)
    check_size(width, height, 2 * 4096 * 4096)
    stride, mask_stride = (width * depth + 31) // 32 * 4, (width + 31) // 32 * 4
    masks = [0x7C00, 0x3E0, 0x1F] if depth == 16 else [0xFF0000, 0xFF00, 0xFF]
    at = size
    if compression == 3:
        masks = list(struct.unpack_from("<3I", data, 40))
        at += 12 if size == 40 else 0
    n = min(1 << depth, used or 1 << depth) if depth <= 8 else 0
    palette = np.frombuffer(data, np.uint8, n * 4, at).reshape(n, 4)[:, 2::-1] if n and len(data) >= at + n * 4 else None
    if n and palette is None:
        raise DecodeFailed("the palette is cut off")
    at += n * 4
    half = height // 2
    doubled = height % 2 == 0 and (half == stated or len(data) - at < stride * height)
    height = half if doubled else height
    check_size(width, height, 4096 * 4096)
    if len(data) < at + stride * height:
        raise DecodeFailed("the file holds fewer pixels than it says")
    rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
    at += stride * height
    has_mask = doubled and len(data) >= at + mask_stride * height
    mask = unpack_bits(np.frombuffer(data, np.uint8, mask_stride * height, at).reshape(height, -1), 1, width) if has_mask else np.zeros((height, width), np.uint8)
    alpha = np.where(mask, 0, 255).astype(np.uint8)
    if palette is not None:
        index = unpack_bits(rows, depth, width)
        if index.max(initial=0) >= len(palette):
            raise DecodeFailed("a pixel is outside the palette")
        rgb = palette[index]
    elif depth == 24:
        rgb = rows[:, : width * 3].reshape(height, width, 3)[..., ::-1]
    else:
        values = np.ascontiguousarray(rows[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4")
        rgb = np.stack([masked(values, m) if m else np.zeros(values.shape, np.uint8) for m in masks], axis=2)
        if depth == 32 and (values >> 24).any():
            alpha = (values >> 24).astype(np.uint8)
    out = np.concatenate([rgb, alpha[..., None]], axis=2)
    return with_alpha(np.ascontiguousarray(out if top_down else out[::-1]))


def encode(image: Raster) -> bytes:
    """PNG entries of the usual sides up to the longest one."""
    longest = max(image.width, image.height, 16)
    entries = [(side, png.encode(fit_square(image, side))) for side in SIDES if side <= longest]
    if not entries:
        raise EncodeFailed("an icon has an entry")
    head, at = bytearray(struct.pack("<HHH", 0, 1, len(entries))), 6 + 16 * len(entries)
    for side, body in entries:
        head += struct.pack("<BBBBHHII", side & 255, side & 255, 0, 0, 1, 32, len(body), at)
        at += len(body)
    return bytes(head) + b"".join(body for _, body in entries)
