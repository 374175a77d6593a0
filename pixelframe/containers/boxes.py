"""ISO base media boxes, read and written."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import HeifMalformed


@dataclass(frozen=True)
class Box:
    type: str
    start: int
    body: int
    end: int


class Bytes:
    """Big-endian reads within [at, end) of a file."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def number(self, size: int) -> int:
        if self.at + size > self.end:
            raise HeifMalformed("a box ends early")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise HeifMalformed("a box ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        """Up to a zero byte, which is taken too, or to the end."""
        stop = self.data.find(b"\0", self.at, self.end)
        out = self.data[self.at : self.end if stop < 0 else stop]
        self.at = self.end if stop < 0 else stop + 1
        return out.decode("utf-8", "replace")

    def full(self) -> tuple[int, int]:
        """Version and flags of a full box."""
        return self.number(1), self.number(3)


def walk(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Box]:
    """The boxes between two places. A size of 1 is followed by a long one, a size of 0 reaches to the end."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise HeifMalformed("a long box is cut off")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise HeifMalformed("a box leaves its parent")
        yield Box(kind.decode("latin-1"), at, body, at + size)
        at += size


def find(data: bytes, kind: str, at: int = 0, end: int | None = None) -> Box | None:
    return next((b for b in walk(data, at, end) if b.type == kind), None)


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, bytes((version,)) + flags.to_bytes(3, "big"), *parts)
