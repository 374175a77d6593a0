"""Sun raster files."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import check_size, unpack_bits

_MAGIC = 0x59A66A95


def _expand(data: bytes, size: int) -> bytes:
    """0x80 n v repeats v n + 1 times; 0x80 0 is a literal 0x80."""
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise DecodeFailed("the runs end early")
        if data[at] != 0x80:
            nxt = data.find(b"\x80", at)
            nxt = len(data) if nxt < 0 else nxt
            out += data[at:nxt]
            at = nxt
        elif data[at + 1 : at + 2] == b"\0":
            out.append(0x80)
            at += 2
        else:
            if at + 2 >= len(data):
                raise DecodeFailed("the runs end early")
            out += data[at + 2 : at + 3] * (data[at + 1] + 1)
            at += 3
    return bytes(out[:size])


def decode(data: bytes) -> Raster:
    if len(data) < 32:
        raise DecodeFailed("no raster header")
    magic, width, height, depth, _, kind, map_kind, map_length = struct.unpack_from(">8I", data)
    if magic != _MAGIC:
        raise DecodeFailed("no raster header")
    if kind not in (0, 1, 2, 3) or depth not in (1, 8, 24, 32):
        raise DecodeFailed("the raster is of no known kind")
    check_size(width, height)
    if map_kind not in (0, 1) or (map_kind == 1 and (map_length % 3 or map_length > 768 or depth > 8)):
        raise DecodeFailed("the colour map is of no known kind")
    stride = (width * depth + 15) // 16 * 2
    body = data[32 + map_length :]
    body = _expand(body, stride * height) if kind == 2 else body
    if len(body) < stride * height:
        raise DecodeFailed("the file holds fewer pixels than it says")
    rows = np.frombuffer(body, np.uint8, stride * height).reshape(height, stride)
    if depth <= 8:
        index = unpack_bits(rows, depth, width)
        if map_kind and map_length:
            table = np.frombuffer(data, np.uint8, map_length, 32).reshape(3, -1).T
            if index.max(initial=0) >= len(table):
                raise DecodeFailed("a pixel is outside the colour map")
            return opaque(table[index])
        grey = index if depth == 8 else ((1 - index) * 255).astype(np.uint8)
        return opaque(np.repeat(grey[..., None], 3, axis=2))
    step = depth // 8
    pixels = rows[:, : width * step].reshape(height, width, step)
    rgb = pixels[..., step - 3 :] if kind == 3 else pixels[..., step - 3 :][..., ::-1]
    if step == 4 and pixels[..., 0].any():
        return with_alpha(np.concatenate([rgb, pixels[..., :1]], axis=2))
    return opaque(rgb)


def encode(image: Raster, alpha: bool | None = None) -> bytes:
    """Type 1: blue, green, red, with alpha in front where it is wanted."""
    deep = image.has_alpha if alpha is None else alpha
    step = 4 if deep else 3
    rows = np.zeros((image.height, (image.width * step * 8 + 15) // 16 * 2), np.uint8)
    rows[:, : image.width * step] = image.data[..., [3, 2, 1, 0] if deep else [2, 1, 0]].reshape(image.height, -1)
    return struct.pack(">8I", _MAGIC, image.width, image.height, step * 8, rows.size, 1, 0, 0) + rows.tobytes()
