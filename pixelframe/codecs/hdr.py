"""Radiance RGBE."""

from __future__ import annotations

import re

import numpy as np

from ..errors import DecodeFailed
from ..raster import LINEAR, Raster
from .bits import check_size

_SIZE = re.compile(rb"([+-])([XY]) (\d+) ([+-])([XY]) (\d+)\s*$")


def decode(data: bytes) -> Raster:
    """Scene light; exposures that the header states are divided out."""
    at, exposure, space, form = 0, 1.0, "srgb", None
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise DecodeFailed("the header does not end")
        line, at = data[at:end].rstrip(b"\r"), end + 1
        if not line:
            break
        name, _, value = line.partition(b"=")
        try:
            if name == b"FORMAT":
                form = value.strip()
            elif name == b"EXPOSURE":
                exposure *= float(value)
            elif name in (b"GAMMA", b"PIXASPECT", b"COLORCORR") and any(abs(float(v) - 1) > 1e-6 for v in value.split()):
                raise DecodeFailed(f"{name.decode()} other than 1 is not read")
            elif name == b"PRIMARIES" and np.allclose([float(v) for v in value.split()][:6], (0.68, 0.32, 0.265, 0.69, 0.15, 0.06), atol=0.002):
                space = "display-p3"
        except ValueError:
            raise DecodeFailed("a number in the header is wrong") from None
    if form not in (None, b"32-bit_rle_rgbe"):
        raise DecodeFailed("only RGBE pictures are read")
    end = data.find(b"\n", at)
    size = _SIZE.match(data[at : max(end, at)])
    if not size or size[2] != b"Y" or size[5] != b"X":
        raise DecodeFailed("the size is missing or its rows are columns")
    height, width = int(size[3]), int(size[6])
    check_size(width, height, 100_000_000)
    if not exposure > 0:
        raise DecodeFailed("the exposure is not positive")
    at = end + 1
    rows = np.empty((height, width, 4), np.uint8)
    for y in range(height):
        rows[y], at = _line(data, at, width)
    if size[1] == b"+":
        rows = rows[::-1]
    if size[4] == b"-":
        rows = rows[:, ::-1]
    out = np.ones((height, width, 4), np.float32)
    scale = np.ldexp(1.0, rows[..., 3].astype(np.int64) - 136) / exposure
    out[..., :3] = np.where(rows[..., 3:] > 0, (rows[..., :3] + 0.5) * scale[..., None], 0)
    return Raster(out, space, False)


def _line(data: bytes, at: int, width: int) -> tuple[np.ndarray, int]:
    head = data[at : at + 4]
    if len(head) < 4:
        raise DecodeFailed("the rows end early")
    if 8 <= width <= 32767 and head[:2] == b"\2\2" and head[2] < 128:
        if head[2] << 8 | head[3] != width:
            raise DecodeFailed("a row has another width")
        at, planes = at + 4, []
        for _ in range(4):
            plane = bytearray()
            while len(plane) < width:
                n = data[at] if at < len(data) else 0
                take = 1 if n > 128 else n
                piece = data[at + 1 : at + 1 + take]
                if not n or len(piece) < take:
                    raise DecodeFailed("the rows end early")
                plane += piece * (n - 128) if n > 128 else piece
                at += 1 + take
            if len(plane) != width:
                raise DecodeFailed("a run leaves its row")
            planes.append(np.frombuffer(bytes(plane), np.uint8))
        return np.stack(planes, axis=1), at
    out, shift = bytearray(), 0
    while len(out) < width * 4:
        pixel = data[at : at + 4]
        if len(pixel) < 4:
            raise DecodeFailed("the rows end early")
        at += 4
        if pixel[:3] == b"\1\1\1" and out:
            out += bytes(out[-4:]) * (pixel[3] << shift)
            shift += 8
            if shift > 24:
                raise DecodeFailed("a run is too long")
        else:
            out += pixel
            shift = 0
    if len(out) != width * 4:
        raise DecodeFailed("a run leaves its row")
    return np.frombuffer(bytes(out), np.uint8).reshape(width, 4), at


def to_rgbe(rgb: np.ndarray) -> np.ndarray:
    """Mantissas and shared exponent; what is not above 1e-38 is zero."""
    rgb = np.clip(np.nan_to_num(rgb.astype(np.float64), nan=0.0), 0, 1.7e38)
    top = rgb.max(axis=-1)
    _, e = np.frexp(top)
    out = np.zeros((*rgb.shape[:-1], 4), np.uint8)
    lit = top > 1e-38
    out[..., :3] = np.where(lit[..., None], np.minimum(np.floor(np.ldexp(rgb, (8 - e)[..., None])), 255), 0)
    out[..., 3] = np.where(lit, np.clip(e + 128, 1, 255), 0)
    return out


def _packed(plane: np.ndarray) -> bytes:
    from .bits import runs_of

    out, single, start_single = bytearray(), 0, 0
    for start, n in [*runs_of(plane), (len(plane), 0)]:
        if 0 < n < 3:
            start_single = start if not single else start_single
            single += n
            continue
        for a in range(start_single, start_single + single, 128):
            b = min(a + 128, start_single + single)
            out.append(b - a)
            out += plane[a:b].tobytes()
        single = 0
        while n:
            k = min(n, 127)
            out += bytes((128 + k, int(plane[start])))
            n -= k
    return bytes(out)


def encode(image: Raster, background: tuple[int, int, int] = (255, 255, 255)) -> bytes:
    """Light as it is, bytes through the sRGB curve; alpha is composited on ``background``."""
    if image.is_light:
        light, alpha = image.data[..., :3].astype(np.float64), image.data[..., 3:].astype(np.float64)
    else:
        light, alpha = LINEAR[image.data[..., :3]].astype(np.float64), image.data[..., 3:] / 255.0
    if image.has_alpha:
        light = light * alpha + LINEAR[list(background)].astype(np.float64) * (1 - alpha)
    rows = to_rgbe(light)
    head = b"#?RADIANCE\n" + (b"PRIMARIES=0.680 0.320 0.265 0.690 0.150 0.060 0.3127 0.3290\n" if image.colour_space == "display-p3" else b"")
    out = bytearray(head + b"FORMAT=32-bit_rle_rgbe\n\n" + f"-Y {image.height} +X {image.width}\n".encode())
    for row in rows:
        if 8 <= image.width <= 32767:
            out += bytes((2, 2, image.width >> 8, image.width & 255))
            for c in range(4):
                out += _packed(np.ascontiguousarray(row[:, c]))
        else:
            out += row.tobytes()
    return bytes(out)
