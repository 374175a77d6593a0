"""X bitmaps: C source with one bit for each pixel."""

from __future__ import annotations

import re

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, with_alpha
from .bits import check_size, unpack_bits

_DEFINE = re.compile(r"#\s*define\s+(\w*)\s+(-?(?:0[xX][0-9a-fA-F]+|\d+))")
_NUMBER = re.compile(r"-?(?:0[xX][0-9a-fA-F]+|\d+)")


def _int(text: str) -> int:
    sign, digits = (-1, text[1:]) if text.startswith("-") else (1, text)
    if digits[:2] in ("0x", "0X"):
        return sign * int(digits, 16)
    return sign * int(digits, 8 if len(digits) > 1 and digits[0] == "0" and not re.search("[89]", digits) else 10)


def decode(data: bytes) -> Raster:
    text = re.sub(r"/\*.*?\*/", " ", data.decode("latin-1"), flags=re.S)
    sizes = {}
    for name, value in _DEFINE.findall(text):
        for side in ("width", "height"):
            if name == side or name.endswith("_" + side):
                sizes.setdefault(side, _int(value))
    if len(sizes) < 2:
        raise DecodeFailed("the width or the height is not defined")
    width, height = sizes["width"], sizes["height"]
    check_size(width, height)
    head, brace, body = text.partition("{")
    if not brace or "}" not in body:
        raise DecodeFailed("there are no bits")
    unit = 2 if re.search(r"\bshort\b", head) else 1
    values = [_int(v) & (0xFFFF if unit == 2 else 0xFF) for v in _NUMBER.findall(body.partition("}")[0])]
    per_row = (width + 8 * unit - 1) // (8 * unit)
    if len(values) < per_row * height:
        raise DecodeFailed("the file holds fewer bits than it says")
    rows = np.array(values[: per_row * height], "<u2" if unit == 2 else np.uint8).view(np.uint8).reshape(height, -1)
    out = np.zeros((height, width, 4), np.uint8)
    out[..., 3] = unpack_bits(rows, 1, width, lsb_first=True) * 255
    return with_alpha(out)


def ink_of(image: Raster) -> np.ndarray:
    """Pixels that are dark and not clear."""
    luma = image.data[..., :3].astype(np.float64) @ (0.299, 0.587, 0.114)
    return (image.data[..., 3] >= 128) & (luma < 128)


def identifier(name: str, default: str = "image") -> str:
    clean = re.sub(r"\W", "_", name, flags=re.A).strip("_")
    return default if not clean else clean if not clean[0].isdigit() else f"_{clean}"


def encode(image: Raster, name: str = "image") -> bytes:
    rows = np.packbits(ink_of(image), axis=1, bitorder="little")
    title = identifier(name)
    lines = [", ".join(f"0x{v:02x}" for v in row) for row in np.array_split(rows.ravel(), max(1, -(-rows.size // 12)))]
    return f"#define {title}_width {image.width}\n#define {title}_height {image.height}\nstatic unsigned char {title}_bits[] = {{\n   {(',' + chr(10) + '   ').join(lines)} }};\n".encode()


__all__ = ["decode", "encode", "identifier", "ink_of"]
