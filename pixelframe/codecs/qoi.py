"""The Quite OK image format."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import check_size

_END = bytes(7) + b"\1"


def decode(data: bytes) -> Raster:
    if len(data) < 22 or data[:4] != b"qoif":
        raise DecodeFailed("no QOI header")
    width, height, channels = struct.unpack_from(">IIB", data, 4)
    check_size(width, height)
    if channels not in (3, 4) or data[-8:] != _END:
        raise DecodeFailed("the header or the end mark is wrong")
    n, at, stop = width * height, 14, len(data) - 8
    if n > 62 * (stop - at):
        raise DecodeFailed("the file is too short for its pixels")
    out, seen = bytearray(), [b"\0\0\0\0"] * 64
    r, g, b, a = 0, 0, 0, 255
    made = 0
    try:
        while made < n:
            op = data[at]
            at += 1
            run = 1
            if op == 254:
                r, g, b = data[at : at + 3]
                at += 3
            elif op == 255:
                r, g, b, a = data[at : at + 4]
                at += 4
            elif op < 64:
                r, g, b, a = seen[op]
            elif op < 128:
                r, g, b = (r + (op >> 4 & 3) - 2) & 255, (g + (op >> 2 & 3) - 2) & 255, (b + (op & 3) - 2) & 255
            elif op < 192:
                d, more = (op & 63) - 32, data[at]
                at += 1
                r, g, b = (r + d + (more >> 4) - 8) & 255, (g + d) & 255, (b + d + (more & 15) - 8) & 255
            else:
                run = (op & 63) + 1
            pixel = bytes((r, g, b, a))
            seen[(r * 3 + g * 5 + b * 7 + a * 11) & 63] = pixel
            made += run
            out += pixel * run
            if at > stop:
                raise DecodeFailed("the chunks end early")
    except (IndexError, ValueError):
        raise DecodeFailed("the chunks end early") from None
    if made != n or at != stop:
        raise DecodeFailed("the chunks and the size differ")
    pixels = np.frombuffer(bytes(out), np.uint8).reshape(height, width, 4)
    return with_alpha(pixels.copy()) if channels == 4 else opaque(pixels[..., :3])


def encode(image: Raster) -> bytes:
    out = bytearray(b"qoif" + struct.pack(">IIBB", image.width, image.height, 4 if image.has_alpha else 3, 0))
    flat = image.data.reshape(-1, 4)
    if not image.has_alpha:
        flat = flat.copy()
        flat[:, 3] = 255
    if not len(flat):
        return bytes(out) + _END
    wide = flat.astype(np.int64)
    before = np.concatenate([[[0, 0, 0, 255]], wide[:-1]])
    starts = np.flatnonzero((wide != before).any(axis=1))
    lengths = np.diff(np.append(starts, len(flat)))
    new, old = wide[starts], before[starts]
    slots = ((new @ (3, 5, 7, 11)) & 63).tolist()
    pixels = (new @ (1 << 24, 1 << 16, 1 << 8, 1)).tolist()
    dr, dg, db = (((new - old)[:, :3] + 128 & 255) - 128).T
    small = (np.minimum(np.minimum(dr, dg), db) >= -2) & (np.maximum(np.maximum(dr, dg), db) <= 1)
    luma = (np.abs(2 * dg + 1) <= 63) & (np.abs(2 * (dr - dg) + 1) <= 15) & (np.abs(2 * (db - dg) + 1) <= 15)
    kind = np.where(new[:, 3] != old[:, 3], 3, np.where(small, 0, np.where(luma, 1, 2))).tolist()
    # What stands for a pixel that was not seen: the bytes as one number, with a one before them.
    short = 256 | 64 | dr + 2 << 4 | dg + 2 << 2 | db + 2
    middle = 65536 | (128 | dg + 32) << 8 | dr - dg + 8 << 4 | db - dg + 8
    rgb = new[:, 0] << 16 | new[:, 1] << 8 | new[:, 2]
    codes = np.where(new[:, 3] != old[:, 3], 1 << 40 | 255 << 32 | rgb << 8 | new[:, 3], np.where(small, short, np.where(luma, middle, 1 << 32 | 254 << 24 | rgb))).tolist()
    sizes = (1, 2, 4, 5)
    seen = [-1] * 64

    def again(n: int) -> None:
        while n > 0:
            out.append(0xC0 | (min(n, 62) - 1))
            n -= 62

    head = int(starts[0]) if len(starts) else len(flat)
    if head:
        again(head)
        seen[(255 * 11) & 63] = 255
    for slot, pixel, code, k, n in zip(slots, pixels, codes, kind, lengths.tolist(), strict=True):
        if seen[slot] == pixel:
            out.append(slot)
        else:
            seen[slot] = pixel
            out += code.to_bytes(sizes[k] + 1, "big")[1:]
        if n > 1:
            again(n - 1)
    return bytes(out) + _END
