"""JPEG containers: segments, sizes and metadata."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..errors import DecodeFailed

#: Markers of frames, and markers without a length.
_FRAMES = (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0))
_BARE = (0x01, *range(0xD0, 0xD9))
_EXIF, _ICC = b"Exif\0\0", b"ICC_PROFILE\0"


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, marker, body) of the segments before the first scan."""
    if data[:2] != b"\xff\xd8":
        raise DecodeFailed("no JPEG signature")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise DecodeFailed("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in _BARE:
            at += 2
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2 or at + 2 + n > len(data):
            raise DecodeFailed("a segment is cut off")
        yield at, marker, data[at + 4 : at + 2 + n]
        if marker == 0xDA:
            return
        at += 2 + n


def size(data: bytes) -> tuple[int, int]:
    for _, marker, body in segments(data):
        if marker in _FRAMES and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
            return width, height
    raise DecodeFailed("there is no frame")


def exif(data: bytes) -> bytes | None:
    return next((b[6:] for _, m, b in segments(data) if m == 0xE1 and b.startswith(_EXIF)), None)


def icc(data: bytes) -> bytes | None:
    """The profile, put together from its numbered parts; None if one is missing."""
    parts, total = {}, 0
    for _, marker, body in segments(data):
        if marker == 0xE2 and body.startswith(_ICC) and len(body) >= 14:
            parts[body[12]], total = body[14:], body[13]
    return b"".join(parts[i] for i in range(1, total + 1)) if total and set(parts) >= set(range(1, total + 1)) else None


def with_metadata(data: bytes, exif_payload: bytes | None = None, profile: bytes | None = None) -> bytes:
    """The segments put in after the last APP0, where the file has none of the kind."""
    at, has_exif, has_icc = 2, False, False
    for offset, marker, body in segments(data):
        if marker == 0xE0:
            at = offset + 4 + len(body)
        has_exif |= marker == 0xE1 and body.startswith(_EXIF)
        has_icc |= marker == 0xE2 and body.startswith(_ICC)
    make = lambda marker, body: b"\xff" + bytes((marker,)) + struct.pack(">H", len(body) + 2) + body
    more = b""
    if exif_payload and not has_exif and len(exif_payload) + 8 <= 65535:
        more += make(0xE1, _EXIF + exif_payload)
    if profile and not has_icc:
        pieces = [profile[i : i + 65519] for i in range(0, len(profile), 65519)]
        if len(pieces) <= 255:
            more += b"".join(make(0xE2, _ICC + bytes((i + 1, len(pieces))) + p) for i, p in enumerate(pieces))
    return data[:at] + more + data[at:]


def previews(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, size, width, height) of complete JPEG streams anywhere in a file, such as a camera's raw file."""
    out, at = [], data.find(b"\xff\xd8\xff")
    while at >= 0:
        try:
            w, h = size(data[at:])
            scan = max(o for o, m, _ in segments(data[at:]) if m == 0xDA)
            end = scan
            while True:  # entropy-coded data: FF is followed by 00 or a restart mark
                end = data.find(b"\xff", at + end + 2) - at
                if end < 0:
                    break
                follow = data[at + end + 1 : at + end + 2]
                if follow == b"\xd9":
                    out.append((at, end + 2, w, h))
                    break
            at = data.find(b"\xff\xd8\xff", at + (max(end, 0) + 2 if end > 0 else 2))
        except (DecodeFailed, ValueError):
            at = data.find(b"\xff\xd8\xff", at + 2)
    return out


def best_preview(data: bytes) -> bytes:
    """The preview of the largest area, the earliest of equals."""
    found = previews(data)
    if not found:
        raise DecodeFailed("the file holds no preview")
    at, n, _, _ = max(found, key=lambda p: (p[2] * p[3], -p[0]))
    return data[at : at + n]
