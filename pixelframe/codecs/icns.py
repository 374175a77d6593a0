"""Apple icons."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..errors import DecodeFailed, ImageError
from ..raster import Raster, fit_square, opaque, with_alpha
from . import png

#: Record types of packed RGB and their mask, of packed ARGB, and of PNG with the side that is meant.
_RGB = {"is32": (16, "s8mk"), "il32": (32, "l8mk"), "ih32": (48, "h8mk"), "it32": (128, "t8mk")}
_ARGB = {"ic04": 16, "ic05": 32, "icsb": 18, "icsB": 36, "SB24": 24}
_PNG = {"icp4": 16, "icp5": 32, "icp6": 64, "ic07": 128, "ic08": 256, "ic09": 512, "ic10": 1024, "ic11": 32, "ic12": 64, "ic13": 256, "ic14": 512}
_RETINA = ("ic10", "ic11", "ic12", "ic13", "ic14", "icsB")
#: Records that are written: type and side.
WRITTEN = (("icp4", 16), ("icp5", 32), ("icp6", 64), ("ic07", 128), ("ic08", 256), ("ic09", 512), ("ic10", 1024), ("ic11", 32), ("ic12", 64), ("ic13", 256))


@dataclass(frozen=True)
class Entry:
    type: str
    kind: str
    side: int
    retina: bool
    offset: int
    size: int


def directory(data: bytes) -> list[Entry]:
    if len(data) < 8 or data[:4] != b"icns":
        raise DecodeFailed("no icon header")
    end = min(len(data), struct.unpack_from(">I", data, 4)[0])
    at, out = 8, []
    while at + 8 <= end:
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from(">I", data, at + 4)[0]
        if size < 8 or at + size > end:
            raise DecodeFailed("a record lies outside the file")
        body = data[at + 8 : at + size]
        if body.startswith(png.SIGNATURE) and len(body) >= 24:
            kind, side = "png", max(struct.unpack_from(">II", body, 16))
        elif body.startswith((b"\0\0\0\x0cjP  ", b"\xff\x4f\xff\x51")):
            kind, side = "jpeg2000", _PNG.get(name, 0)
        elif name in _RGB:
            kind, side = "rgb", _RGB[name][0]
        elif name in _ARGB and body[:4] == b"ARGB":
            kind, side = "argb", _ARGB[name]
        else:
            kind, side = "mask" if name.endswith("8mk") else "other", 0
        out.append(Entry(name, kind, side, name in _RETINA, at + 8, size - 8))
        at += size
    return out


def _planes(data: bytes, n: int, count: int) -> list[np.ndarray]:
    """Planes of ``n`` bytes: a control under 128 copies one more byte than it says, else repeats one 125 times fewer."""
    out, at = bytearray(), 0
    while len(out) < n * count:
        if at >= len(data):
            raise DecodeFailed("the runs end early")
        c = data[at]
        piece = data[at + 1 : at + 2 + c] if c < 128 else data[at + 1 : at + 2] * (c - 125)
        if not piece or (c < 128 and len(piece) <= c):
            raise DecodeFailed("the runs end early")
        out += piece
        at += c + 2 if c < 128 else 2
    return [np.frombuffer(bytes(out[i * n : i * n + n]), np.uint8) for i in range(count)]


def decode(data: bytes) -> Raster:
    """The largest entry that can be read, plain before retina; the best one's error if none can."""
    entries = directory(data)
    masks = {e.type: data[e.offset : e.offset + e.size] for e in entries if e.kind == "mask"}
    ranked = sorted((e for e in entries if e.side), key=lambda e: (-e.side, e.retina))
    first: ImageError | None = None
    for e in ranked:
        body = data[e.offset : e.offset + e.size]
        try:
            if e.kind == "png":
                return png.decode(body).image
            if e.kind == "jpeg2000":
                raise DecodeFailed("JPEG 2000 entries are not read")
            n = e.side * e.side
            if e.kind == "argb":
                a, r, g, b = _planes(body[4:], n, 4)
                return with_alpha(np.stack([r, g, b, a], axis=1).reshape(e.side, e.side, 4))
            if e.type == "it32":
                body = body[4:]
            colours = np.frombuffer(body, np.uint8, n * 4).reshape(n, 4)[:, 1:] if len(body) == n * 4 else np.stack(_planes(body, n, 3), axis=1)
            mask = masks.get(_RGB[e.type][1])
            rgb = colours.reshape(e.side, e.side, 3)
            if mask is None or len(mask) < n:
                return opaque(rgb)
            return with_alpha(np.concatenate([rgb, np.frombuffer(mask, np.uint8, n).reshape(e.side, e.side, 1)], axis=2))
        except ImageError as error:
            first = first or error
    raise first or DecodeFailed("there is no picture")


def encode(image: Raster) -> bytes:
    longest = max(image.width, image.height, 16)
    made: dict[int, bytes] = {}
    body = b""
    for name, side in WRITTEN:
        if side <= longest:
            made.setdefault(side, png.encode(fit_square(image, side)))
            body += name.encode() + struct.pack(">I", 8 + len(made[side])) + made[side]
    return b"icns" + struct.pack(">I", 8 + len(body)) + body
