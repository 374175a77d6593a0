"""WebP containers: chunks read, animations put together from still frames."""

from __future__ import annotations

import struct

from ..errors import EncodeFailed
from ..functions.exif import riff_chunks
from ..raster import half_up


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)


def frame_of(still: bytes) -> tuple[bytes, bool]:
    """The picture chunks of a still file, and whether it has alpha."""
    parts = riff_chunks(still)
    kept = [(k, b) for k, b in parts if k in (b"ALPH", b"VP8 ", b"VP8L")]
    if not any(k in (b"VP8 ", b"VP8L") for k, _ in kept):
        raise EncodeFailed("a frame holds no picture")
    lossless = next((b for k, b in kept if k == b"VP8L"), b"")
    alpha = any(k == b"ALPH" for k, _ in kept) or (len(lossless) >= 5 and bool(lossless[4] >> 4 & 1))
    return b"".join(chunk(k, b) for k, b in kept), alpha


def duration(ms: float) -> int:
    return int(min(max(half_up(ms), 0), (1 << 24) - 1))


def mux(width: int, height: int, frames: list[tuple[bytes, float]], loops: int = 0, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    """Whole frames (still file, milliseconds) as an animation; each replaces the last."""
    if not frames or not 1 <= width <= 1 << 24 or not 1 <= height <= 1 << 24:
        raise EncodeFailed("an animation has frames and a size")
    u24 = lambda v: v.to_bytes(3, "little")
    bodies, deep = b"", False
    for still, ms in frames:
        picture, alpha = frame_of(still)
        deep |= alpha
        bodies += chunk(b"ANMF", u24(0) + u24(0) + u24(width - 1) + u24(height - 1) + u24(duration(ms)) + b"\x02" + picture)
    flags = 2 | (16 if deep else 0) | (32 if icc else 0) | (8 if exif else 0)
    out = chunk(b"VP8X", bytes((flags, 0, 0, 0)) + u24(width - 1) + u24(height - 1))
    out += chunk(b"ICCP", icc) if icc else b""
    out += chunk(b"ANIM", bytes(4) + struct.pack("<H", min(max(loops, 0), 65535))) + bodies
    out += chunk(b"EXIF", exif) if exif else b""
    return b"RIFF" + struct.pack("<I", len(out) + 4) + b"WEBP" + out
