"""ZSoft PCX."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, exact_palette, flatten, opaque, with_alpha
from .bits import check_size, runs_of, unpack_bits

#: The sixteen EGA colours.
EGA = np.array([(r, g, b) for i in range(16) for r, g, b in [[(170 * (i >> s & 1) + 85 * (i >> 3)) for s in (2, 1, 0)]]], np.uint8)
EGA[6] = (170, 85, 0)


def _expand(data: bytes, at: int, size: int) -> bytes:
    """A byte of 192 and more repeats the next one as often as its low six bits say."""
    out = bytearray()
    while len(out) < size:
        if at >= len(data):
            raise DecodeFailed("the runs end early")
        if data[at] >= 192:
            out += data[at + 1 : at + 2] * (data[at] & 63)
            at += 2
        else:
            out.append(data[at])
            at += 1
    return bytes(out[:size])


def decode(data: bytes) -> Raster:
    if len(data) < 128 or data[0] != 10:
        raise DecodeFailed("no PCX header")
    version, coding, depth = data[1:4]
    x0, y0, x1, y1 = struct.unpack_from("<4H", data, 4)
    planes, stride, info = data[65], *struct.unpack_from("<HH", data, 66)
    width, height = x1 - x0 + 1, y1 - y0 + 1
    check_size(width, height, 80_000_000)
    if version not in (0, 2, 3, 4, 5) or coding not in (0, 1) or (depth, planes) not in ((1, 1), (2, 1), (4, 1), (8, 1), (1, 2), (1, 3), (1, 4), (8, 3), (8, 4)):
        raise DecodeFailed("the picture is of no known kind")
    if stride * 8 < width * depth:
        raise DecodeFailed("the rows are too short")
    size = stride * planes * height
    body = _expand(data, 128, size) if coding else data[128 : 128 + size]
    if len(body) < size:
        raise DecodeFailed("the file holds fewer pixels than it says")
    rows = np.frombuffer(body, np.uint8).reshape(height, planes, stride)
    if depth == 8 and planes >= 3:
        colour = np.moveaxis(rows[:, :, :width], 1, 2)
        return opaque(colour) if planes == 3 else with_alpha(np.ascontiguousarray(colour))
    header = np.frombuffer(data, np.uint8, 48, 16).reshape(16, 3)
    if depth == 8:
        index = rows[:, 0, :width]
        if version >= 5 and len(data) >= 128 + 769 and data[-769] == 12:
            palette = np.frombuffer(data, np.uint8, 768, len(data) - 768).reshape(256, 3)
        else:
            palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
            if info != 2:
                palette[:16] = header
        return opaque(palette[index])
    index = sum(unpack_bits(rows[:, p], depth, width).astype(np.int64) << (p if depth == 1 else 0) for p in range(planes))
    if depth == 1 and planes == 1:
        palette = np.array([[0, 0, 0], [255, 255, 255]], np.uint8) if (header[0] == header[1]).all() else header[:2]
    else:
        palette = header if header.any() and version != 3 else EGA
    return opaque(palette[index])


def _packed(line: np.ndarray) -> bytes:
    out = bytearray()
    for start, n in runs_of(line):
        value = int(line[start])
        while n:
            k = min(n, 63)
            if k > 1 or value >= 192:
                out.append(192 + k)
            out.append(value)
            n -= k
    return bytes(out)


def encode(image: Raster) -> bytes:
    """Flattened; eight bits with a palette if at most 256 colours, else three planes."""
    flat = flatten(image)
    indexed = exact_palette(flat)
    planes = [indexed.indices] if indexed else [flat.data[..., c] for c in range(3)]
    stride = (flat.width + 1) // 2 * 2
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 8, 0, 0, flat.width - 1, flat.height - 1, 72, 72) + bytes(48) + struct.pack("<BBHHHH", 0, len(planes), stride, 1, 0, 0) + bytes(54)
    body = bytearray()
    line = np.zeros(stride, np.uint8)
    for y in range(flat.height):
        for plane in planes:
            line[: flat.width] = plane[y]
            body += _packed(line)
    tail = b""
    if indexed:
        table = np.zeros((256, 3), np.uint8)
        table[: len(indexed.palette)] = indexed.palette[:, :3]
        tail = b"\x0c" + table.tobytes()
    return head + bytes(body) + tail
