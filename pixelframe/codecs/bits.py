"""Bounded reading, bit packing and run lengths that several codecs share."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed, TooLarge

#: No reader makes more pixels than this, whatever the caller allows.
MOST_PIXELS = 400_000_000


class Reader:
    """Bytes with a place in them; reading past the end is a decode error."""

    def __init__(self, data: bytes, little: bool = True, what: str = "file"):
        self.data, self.at, self.mark, self.what = data, 0, "<" if little else ">", what

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DecodeFailed(f"the {self.what} ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, codes: str) -> tuple:
        return struct.unpack(self.mark + codes, self.take(struct.calcsize(self.mark + codes)))

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return self.read("H")[0]

    def u32(self) -> int:
        return self.read("I")[0]

    @property
    def left(self) -> int:
        return len(self.data) - self.at


def check_size(width: int, height: int, most: int = MOST_PIXELS) -> None:
    if width < 1 or height < 1:
        raise DecodeFailed("the picture has no pixels")
    if width * height > most:
        raise TooLarge(f"{width} x {height} pixels are more than {most}")


def unpack_bits(rows: np.ndarray, depth: int, width: int, lsb_first: bool = False) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits from rows of bytes, ``width`` to a row."""
    if depth == 8:
        return rows[:, :width]
    if depth == 1:
        return np.unpackbits(rows, axis=1, bitorder="little" if lsb_first else "big")[:, :width]
    per = 8 // depth
    shifts = np.arange(per) * depth if lsb_first else np.arange(per)[::-1] * depth
    return ((rows[:, :, None] >> shifts.astype(np.uint8)) & ((1 << depth) - 1)).reshape(len(rows), -1)[:, :width]


def rows_of(data: bytes, stride: int, height: int, what: str) -> np.ndarray:
    if len(data) < stride * height:
        raise DecodeFailed(f"the {what} holds fewer pixels than it says")
    return np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)


def scaled(samples: np.ndarray, most: int) -> np.ndarray:
    """Samples of 0..most as bytes, half up."""
    if most == 255:
        return samples.astype(np.uint8)
    return np.floor(np.minimum(samples, most).astype(np.float64) * 255 / most + 0.5).astype(np.uint8)


def masked(values: np.ndarray, mask: int) -> np.ndarray | None:
    """The channel of a bit mask as bytes; None for an empty mask. The bits are contiguous from the lowest."""
    if not mask:
        return None
    shift = (mask & -mask).bit_length() - 1
    width = 0
    while mask >> (shift + width) & 1:
        width += 1
    most = (1 << width) - 1
    return scaled((values.astype(np.uint64) >> np.uint64(shift)) & np.uint64(most), most)


def runs_of(line: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of runs of equal rows of ``line``."""
    if len(line) < 2:
        return [(0, 1)] * len(line)
    changed = (line[1:] != line[:-1]).reshape(len(line) - 1, -1).any(axis=1)
    starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
    return list(zip(starts.tolist(), np.diff(np.concatenate([starts, [len(line)]])).tolist(), strict=True))


def unpack_packbits(data: bytes, size: int) -> bytes:
    """PackBits: n < 128 copies n + 1 bytes, n > 128 repeats one byte 257 - n times, 128 does nothing."""
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise DecodeFailed("packed rows end early")
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + 2 + n]
            if len(piece) <= n:
                raise DecodeFailed("packed rows end early")
            out += piece
            at += n + 2
        elif n > 128:
            if at + 1 >= len(data):
                raise DecodeFailed("packed rows end early")
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])
