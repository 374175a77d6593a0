"""DirectDraw surfaces: block compression 1 to 5, plain and masked pixels; the first surface."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, opaque, with_alpha
from .bits import check_size, masked

_FOURCC = {b"DXT1": "bc1", b"DXT2": "bc2p", b"DXT3": "bc2", b"DXT4": "bc3p", b"DXT5": "bc3", b"ATI1": "bc4", b"BC4U": "bc4", b"BC4S": "bc4s", b"ATI2": "bc5", b"BC5U": "bc5", b"BC5S": "bc5s"}
_DXGI = {70: "bc1", 71: "bc1", 72: "bc1", 73: "bc2", 74: "bc2", 75: "bc2", 76: "bc3", 77: "bc3", 78: "bc3", 79: "bc4", 80: "bc4", 81: "bc4s", 82: "bc5", 83: "bc5", 84: "bc5s", 27: "rgba", 28: "rgba", 29: "rgba", 87: "bgra", 91: "bgra", 88: "bgrx", 93: "bgrx", 61: "r", 49: "rg"}
_PLAIN = {"rgba": (4, (0, 1, 2, 3)), "bgra": (4, (2, 1, 0, 3)), "bgrx": (4, (2, 1, 0, None)), "r": (1, (0, None, None, None)), "rg": (2, (0, 1, None, None))}


def decode(data: bytes) -> Raster:
    if len(data) < 128 or data[:4] != b"DDS ":
        raise DecodeFailed("no DDS header")
    height, width = struct.unpack_from("<II", data, 12)
    flags, code, bits, *masks = struct.unpack_from("<I4sI4I", data, 80)
    check_size(width, height, 80_000_000)
    at, layout, premultiplied = 128, None, False
    if flags & 4:
        if code == b"DX10":
            if len(data) < 148:
                raise DecodeFailed("the header is cut off")
            form, dimension, _, _, more = struct.unpack_from("<5I", data, 128)
            if dimension != 3:
                raise DecodeFailed("only flat surfaces are read")
            layout, at, premultiplied = _DXGI.get(form), 148, more & 7 == 2
        else:
            layout = _FOURCC.get(code)
        if layout is None:
            raise DecodeFailed("the pixel format is not read")
    if layout and layout.startswith("bc"):
        premultiplied |= layout.endswith("p")
        out = _blocks(data, at, width, height, layout.rstrip("p"))
    elif layout:
        step, order = _PLAIN[layout]
        if len(data) < at + width * height * step:
            raise DecodeFailed("the file holds fewer pixels than it says")
        raw = np.frombuffer(data, np.uint8, width * height * step, at).reshape(height, width, step)
        out = np.zeros((height, width, 4), np.uint8)
        out[..., 3] = 255
        for to, source in enumerate(order):
            if source is not None:
                out[..., to] = raw[..., source]
    else:
        out = _masked(data, at, width, height, flags, bits, masks)
    if premultiplied:
        a = out[..., 3:].astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[..., :3] = np.where(a > 0, np.minimum(255, np.floor(out[..., :3] * 255 / a + 0.5)), 0)
    return with_alpha(out) if (out[..., 3] != 255).any() else opaque(out[..., :3])


def _masked(data: bytes, at: int, width: int, height: int, flags: int, bits: int, masks: list[int]) -> np.ndarray:
    if not flags & (0x40 | 0x20000 | 2) or bits not in (8, 16, 24, 32):
        raise DecodeFailed("the pixel format is not read")
    step = bits // 8
    if len(data) < at + width * height * step:
        raise DecodeFailed("the file holds fewer pixels than it says")
    raw = np.frombuffer(data, np.uint8, width * height * step, at).reshape(height, width, step).astype(np.int64)
    values = sum(raw[..., i] << (8 * i) for i in range(step))
    if flags & 0x20000:
        masks = [masks[0]] * 3 + masks[3:]
    out = np.zeros((height, width, 4), np.uint8)
    out[..., 3] = 255
    for c in range(4):
        if c == 3 and not flags & (1 | 2):
            continue
        found = masked(values, masks[c])
        if found is not None:
            out[..., c] = found
    return out


def _ladder(ends: np.ndarray, signed: bool) -> np.ndarray:
    """Eight values from two end points: six between them, or four and the extremes."""
    a, b = (ends[:, i : i + 1].astype(np.int64) for i in (0, 1))
    low, high = (-127, 127) if signed else (0, 255)
    a, b = np.maximum(a, low), np.maximum(b, low)
    k = np.arange(1, 7)
    eight = np.concatenate([a, b, ((7 - k) * a + k * b) // 7], axis=1)
    six = np.concatenate([a, b, ((5 - k[:4]) * a + k[:4] * b) // 5, np.full_like(a, low), np.full_like(a, high)], axis=1)
    return np.where(a > b, eight, six)


def _alpha_block(raw: np.ndarray, signed: bool = False) -> np.ndarray:
    """n x 16 values of interpolated blocks of eight bytes."""
    ends = raw[:, :2].view(np.int8) if signed else raw[:, :2]
    bits = sum(raw[:, 2 + i].astype(np.int64) << (8 * i) for i in range(6))
    index = (bits[:, None] >> (3 * np.arange(16))) & 7
    values = np.take_along_axis(_ladder(ends, signed), index, axis=1)
    return np.clip((values + 127) * 255 // 254, 0, 255) if signed else values


def _colour_block(raw: np.ndarray, punch: bool) -> np.ndarray:
    """n x 16 x 4 colours of blocks of eight bytes."""
    ends = np.ascontiguousarray(raw[:, :4]).view("<u2").astype(np.int64)
    five = np.stack([ends >> 11, ends >> 5 & 63, ends & 31], axis=2)
    c = np.stack([five[..., 0] << 3 | five[..., 0] >> 2, five[..., 1] << 2 | five[..., 1] >> 4, five[..., 2] << 3 | five[..., 2] >> 2], axis=2)
    a, b = c[:, 0], c[:, 1]
    four = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], axis=1)
    three = np.stack([a, b, (a + b) // 2, np.zeros_like(a)], axis=1)
    is_four = (ends[:, 0] > ends[:, 1]) | (not punch)
    colours = np.where(is_four[:, None, None], four, three)
    alpha = np.full((len(raw), 4, 1), 255)
    alpha[~is_four, 3] = 0
    index = (np.ascontiguousarray(raw[:, 4:8]).view("<u4").astype(np.int64) >> (2 * np.arange(16))) & 3
    return np.take_along_axis(np.concatenate([colours, alpha], axis=2), index[..., None], axis=1)


def _blocks(data: bytes, at: int, width: int, height: int, layout: str) -> np.ndarray:
    across, down = (width + 3) // 4, (height + 3) // 4
    size = 8 if layout in ("bc1", "bc4", "bc4s") else 16
    n = across * down
    if len(data) < at + n * size:
        raise DecodeFailed("the file holds fewer blocks than it says")
    raw = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    if layout == "bc1":
        out = _colour_block(raw, True)
    elif layout == "bc2":
        out = _colour_block(raw[:, 8:], False)
        nibbles = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], axis=2).reshape(n, 16)
        out[..., 3] = nibbles.astype(np.int64) * 17
    elif layout == "bc3":
        out = _colour_block(raw[:, 8:], False)
        out[..., 3] = _alpha_block(raw[:, :8])
    else:
        out = np.zeros((n, 16, 4), np.int64)
        out[..., 3] = 255
        signed = layout.endswith("s")
        out[..., 0] = _alpha_block(raw[:, :8], signed)
        if layout.startswith("bc5"):
            out[..., 1] = _alpha_block(raw[:, 8:], signed)
        else:
            out[..., 1] = out[..., 2] = out[..., 0]
    grid = out.astype(np.uint8).reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
    return np.ascontiguousarray(grid[:height, :width])
