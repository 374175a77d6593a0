"""Photoshop documents: the merged picture."""

from __future__ import annotations

import zlib

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import Reader, check_size, unpack_bits, unpack_packbits

_COLOURS = {0: 1, 1: 1, 2: 1, 3: 3, 4: 4, 8: 1}


def decode(data: bytes) -> Raster:
    r = Reader(data, little=False, what="document")
    if r.take(4) != b"8BPS":
        raise DecodeFailed("no Photoshop header")
    version, _, channels, height, width, depth, mode = r.read("H6sHIIHH")
    if version not in (1, 2) or not 1 <= channels <= 56 or depth not in (1, 8, 16, 32):
        raise DecodeFailed("the header is not legal")
    if mode not in _COLOURS or (depth == 1) != (mode == 0):
        raise DecodeFailed("the colour mode is not read")
    check_size(width, height)
    palette = r.take(r.u32())
    r.take(r.u32())
    r.take(r.read("Q")[0] if version == 2 else r.u32())
    colours = _COLOURS[mode]
    if channels < colours:
        raise DecodeFailed("there are fewer channels than the mode needs")
    planes = _planes(r, version, channels, height, width, depth)
    alpha = planes[colours] if channels > colours and mode not in (0, 2) else None
    if mode == 0:
        return opaque(np.repeat(255 - planes[0][..., None] * 255, 3, axis=2).astype(np.uint8))
    if mode == 2:
        if len(palette) < 768:
            raise DecodeFailed("the palette is cut off")
        return opaque(np.frombuffer(palette, np.uint8, 768).reshape(3, 256).T[planes[0]])
    if depth == 32:
        out = np.ones((height, width, 4), np.float32)
        out[..., :3] = np.moveaxis(planes[:3] if colours >= 3 else planes[:1], 0, 2)
        if alpha is not None:
            out[..., 3] = np.clip(alpha, 0, 1)
        return Raster(np.nan_to_num(out, nan=0.0), "srgb", alpha is not None and bool((out[..., 3] < 1).any()))
    b = [p if depth == 8 else (p >> 8).astype(np.uint8) for p in planes]
    if mode == 4:
        k = b[3].astype(np.float64)
        rgb = np.stack([np.clip(np.rint(c * k / 255), 0, 255).astype(np.uint8) for c in b[:3]], axis=2)
    else:
        rgb = np.stack(b[:3] if colours == 3 else [b[0]] * 3, axis=2)
    if alpha is None:
        return opaque(rgb)
    a = b[colours][..., None]
    # The merged picture was drawn on white; that is taken out again.
    with np.errstate(divide="ignore", invalid="ignore"):
        clean = np.clip(np.rint((rgb.astype(np.float64) - 255 + a) * 255 / a), 0, 255)
    rgb = np.where(a == 255, rgb, np.where(a == 0, 0, clean)).astype(np.uint8)
    return with_alpha(np.concatenate([rgb, a], axis=2))


def _planes(r: Reader, version: int, channels: int, height: int, width: int, depth: int) -> list[np.ndarray]:
    coding = r.u16()
    stride = (width * depth + 7) // 8
    size = stride * height * channels
    if coding == 0:
        raw = r.take(size)
    elif coding == 1:
        counts = r.read(f"{height * channels}{'I' if version == 2 else 'H'}")
        raw = b"".join(unpack_packbits(r.take(n), stride) for n in counts)
    elif coding in (2, 3):
        z, parts, left = zlib.decompressobj(), [], r.take(r.left)
        try:
            while sum(map(len, parts)) < size and left:
                parts.append(z.decompress(left, size))
                left = z.unused_data if z.eof else b""
                z = zlib.decompressobj()
        except zlib.error:
            raise DecodeFailed("the pixels do not inflate") from None
        raw = b"".join(parts)[:size]
        if len(raw) < size:
            raise DecodeFailed("the pixels end early")
        if coding == 3:
            raw = _unpredicted(raw, channels * height, width, depth)
    else:
        raise DecodeFailed("the compression is not known")
    rows = np.frombuffer(raw, np.uint8).reshape(channels, height, stride)
    if depth == 1:
        return [unpack_bits(p, 1, width) for p in rows]
    kind = {8: np.uint8, 16: ">u2", 32: ">f4"}[depth]
    return [np.ascontiguousarray(p).view(kind).reshape(height, width).astype(np.dtype(kind).newbyteorder("=")) for p in rows]


def _unpredicted(raw: bytes, rows: int, width: int, depth: int) -> bytes:
    """Undoes the differences along each row; of floats, the bytes of one significance stand together."""
    if depth == 8:
        return np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, width), axis=1, dtype=np.uint8).tobytes()
    if depth == 16:
        v = np.frombuffer(raw, ">u2").reshape(rows, width).astype(np.uint16)
        return np.cumsum(v, axis=1, dtype=np.uint16).astype(">u2").tobytes()
    v = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, width * 4), axis=1, dtype=np.uint8)
    return np.ascontiguousarray(v.reshape(rows, 4, width).transpose(0, 2, 1)).tobytes()
