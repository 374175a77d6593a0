"""Portable anymaps, P1 to P7."""

from __future__ import annotations

import re

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import check_size, scaled, unpack_bits

_GAP = re.compile(rb"(?:[ \t\n\v\f\r]|#[^\n\r]*[\n\r])*")
_NUMBER = re.compile(rb"\d+")


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        at = _GAP.match(data, at).end()
        found = _NUMBER.match(data, at)
        if not found or len(found[0]) > 10:
            raise DecodeFailed("a number is missing in the header")
        out.append(int(found[0]))
        at = found.end()
    return out, at


def _samples(data: bytes, at: int, n: int, most: int) -> np.ndarray:
    size = n * (2 if most > 255 else 1)
    if len(data) - at < size:
        raise DecodeFailed("the file holds fewer samples than it says")
    return np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at)


def _ascii(data: bytes, at: int, n: int) -> np.ndarray:
    words = re.sub(rb"#[^\n\r]*", b" ", data[at:]).split()
    if len(words) < n:
        raise DecodeFailed("the file holds fewer samples than it says")
    try:
        return np.array([int(w) for w in words[:n]], np.int64)
    except ValueError:
        raise DecodeFailed("a sample is no number") from None


def decode(data: bytes) -> Raster:
    kind = data[1:2]
    if kind == b"7":
        return _pam(data)
    bitmap = kind in b"14"
    head, at = _numbers(data, 2, 2 if bitmap else 3)
    width, height = head[:2]
    check_size(width, height)
    most = 1 if bitmap else head[2]
    if not 1 <= most <= 65535:
        raise DecodeFailed("the largest sample is out of range")
    if kind == b"1":
        digits = re.sub(rb"#[^\n\r]*|[^01]", b"", data[at:])
        if len(digits) < width * height:
            raise DecodeFailed("the file holds fewer samples than it says")
        ink = (np.frombuffer(digits, np.uint8, width * height) - 48).reshape(height, width)
    elif kind == b"4":
        stride = (width + 7) // 8
        ink = unpack_bits(_samples(data, at + 1, stride * height, 255).reshape(height, stride), 1, width)
    if bitmap:
        grey = ((1 - ink) * 255).astype(np.uint8)
        return opaque(np.repeat(grey[..., None], 3, axis=2))
    channels = 3 if kind in b"36" else 1
    n = width * height * channels
    raw = _ascii(data, at, n) if kind in b"23" else _samples(data, at + 1, n, most)
    values = scaled(raw, most).reshape(height, width, channels)
    return opaque(np.broadcast_to(values, (height, width, 3)))


def _pam(data: bytes) -> Raster:
    head, at = {}, data.find(b"\n") + 1
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise DecodeFailed("the header does not end")
        line, at = data[at:end].strip(), end + 1
        if line == b"ENDHDR":
            break
        if line and not line.startswith(b"#"):
            name, _, value = line.partition(b" ")
            head[name] = value.strip() if name != b"TUPLTYPE" else (head.get(name, b"") + b" " + value.strip()).strip()
    try:
        width, height, depth, most = (int(head[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    except (KeyError, ValueError):
        raise DecodeFailed("the header lacks a number") from None
    check_size(width, height)
    wanted = {b"BLACKANDWHITE": 1, b"GRAYSCALE": 1, b"RGB": 3, b"BLACKANDWHITE_ALPHA": 2, b"GRAYSCALE_ALPHA": 2, b"RGB_ALPHA": 4}.get(head.get(b"TUPLTYPE", b""), depth)
    if not 1 <= depth <= 4 or depth != wanted or not 1 <= most <= 65535:
        raise DecodeFailed("the tuples are of no known kind")
    values = scaled(_samples(data, at, width * height * depth, most), most).reshape(height, width, depth)
    colour = np.broadcast_to(values[..., : 3 if depth > 2 else 1], (height, width, 3))
    if depth in (1, 3):
        return opaque(colour)
    return with_alpha(np.concatenate([colour, values[..., -1:]], axis=2))


def encode(image: Raster) -> bytes:
    """P6, or P7 with alpha where the picture has one."""
    if image.has_alpha:
        head = f"P7\nWIDTH {image.width}\nHEIGHT {image.height}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"
        return head.encode() + image.data.tobytes()
    return f"P6\n{image.width} {image.height}\n255\n".encode() + image.data[..., :3].tobytes()
