"""farbfeld: 16-bit big-endian RGBA behind a fixed header."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed
from ..raster import Raster, with_alpha
from .bits import check_size


def decode(data: bytes) -> Raster:
    if len(data) < 16 or data[:8] != b"farbfeld":
        raise DecodeFailed("no farbfeld header")
    width, height = struct.unpack(">II", data[8:16])
    check_size(width, height)
    if len(data) < 16 + width * height * 8:
        raise DecodeFailed("the file holds fewer pixels than it says")
    wide = np.frombuffer(data, ">u2", width * height * 4, 16).reshape(height, width, 4)
    return with_alpha(np.floor(wide / 257 + 0.5).astype(np.uint8))


def encode(image: Raster) -> bytes:
    return b"farbfeld" + struct.pack(">II", image.width, image.height) + (image.data.astype(">u2") * 257).astype(">u2").tobytes()
