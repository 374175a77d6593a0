"""Truevision TGA: true colour and grey, plain and run-length coded."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import check_size, runs_of


def _expand(data: bytes, at: int, size: int, step: int) -> bytes:
    """Packets: the high bit repeats one pixel, else pixels follow; they may cross rows."""
    out = bytearray()
    while len(out) < size:
        if at >= len(data):
            raise DecodeFailed("the packets end early")
        n = (data[at] & 127) + 1
        take = step if data[at] & 128 else step * n
        piece = data[at + 1 : at + 1 + take]
        if len(piece) < take:
            raise DecodeFailed("the packets end early")
        out += piece * n if data[at] & 128 else piece
        at += 1 + take
    return bytes(out[:size])


def decode(data: bytes) -> Raster:
    if len(data) < 18:
        raise DecodeFailed("no TGA header")
    id_length, mapped, kind = data[0], data[1], data[2]
    map_length, map_bits = struct.unpack_from("<H", data, 5)[0], data[7]
    width, height, depth, flags = struct.unpack_from("<HHBB", data, 12)
    if kind in (1, 9, 32, 33):
        raise DecodeFailed("colour-mapped pictures are not read")
    if kind not in (2, 3, 10, 11):
        raise DecodeFailed("the picture is of no known kind")
    if depth not in ((8,) if kind in (3, 11) else (15, 16, 24, 32)):
        raise DecodeFailed(f"{depth} bits are not read")
    check_size(width, height)
    at = 18 + id_length + (map_length * ((map_bits + 7) // 8) if mapped else 0)
    step = (depth + 7) // 8
    size = width * height * step
    body = _expand(data, at, size, step) if kind >= 10 else data[at : at + size]
    if len(body) < size:
        raise DecodeFailed("the file holds fewer pixels than it says")
    pixels = np.frombuffer(body, np.uint8).reshape(height, width, step)
    alpha = None
    if step == 1:
        rgb = np.repeat(pixels, 3, axis=2)
    elif step == 2:
        v = pixels[..., 0].astype(np.int64) | pixels[..., 1].astype(np.int64) << 8
        five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=2)
        rgb = (five << 3 | five >> 2).astype(np.uint8)
        alpha = (v >> 15 & 1).astype(np.uint8) * 255 if depth == 16 and flags & 15 == 1 else None
    else:
        rgb = pixels[..., 2::-1]
        alpha = pixels[..., 3] if step == 4 else None
    if not flags & 32:
        rgb, alpha = rgb[::-1], None if alpha is None else alpha[::-1]
    if flags & 16:
        rgb, alpha = rgb[:, ::-1], None if alpha is None else alpha[:, ::-1]
    if alpha is None or not alpha.any():
        return opaque(rgb)
    return with_alpha(np.concatenate([rgb, alpha[..., None]], axis=2))


def encode(image: Raster, alpha: bool | None = None) -> bytes:
    """Run-length coded true colour, top row first, packets within rows, with the version 2 footer."""
    deep = image.has_alpha if alpha is None else alpha
    out = bytearray(struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, image.width, image.height, 32 if deep else 24, 0x28 if deep else 0x20))
    order = [2, 1, 0, 3] if deep else [2, 1, 0]
    for row in np.ascontiguousarray(image.data[..., order]):
        single = 0
        runs = [*runs_of(row), (len(row), 0)]
        for start, n in runs:
            if n == 1:
                single += 1
                continue
            for a in range(start - single, start, 128):
                b = min(a + 128, start)
                out.append(b - a - 1)
                out += row[a:b].tobytes()
            single = 0
            for left in range(n, 0, -128):
                out.append(127 + min(left, 128))
                out += row[start].tobytes()
    return bytes(out) + bytes(8) + b"TRUEVISION-XFILE.\0"
