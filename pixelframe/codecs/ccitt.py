"""CCITT fax coding, groups 3 and 4, of bilevel rows."""

from __future__ import annotations

import numpy as np

from ..errors import DecodeFailed

#: Codes of run lengths 0 to 63, then of 64, 128, ... 1728, then (for both colours) of 1792, ... 2560.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011
0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010
00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010
01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111
011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111
00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010
000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101
000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001
000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101
0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011
0000001100100 0000001100101""".split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Modes of two-dimensional rows: pass, horizontal, and the offset of a vertical one.
MODES = {"0001": "pass", "001": "across", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


def lengths() -> list[int]:
    return [*range(64), *range(64, 1729, 64)]


_RUNS = [dict(zip(codes + LONG, [*lengths(), *range(1792, 2561, 64)], strict=True)) for codes in (WHITE, BLACK)]


class _Bits:
    def __init__(self, data: bytes):
        self.bits = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def code(self, table: dict):
        for n in range(1, 14):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        raise DecodeFailed("a code is not known")

    def run(self, colour: int) -> int:
        total = 0
        while True:
            n = self.code(_RUNS[colour])
            total += n
            if n < 64:
                return total


def _one_dimension(b: _Bits, width: int) -> list[int]:
    """Places at which the colour changes, white first."""
    edges, at, colour = [], 0, 0
    while at < width:
        at += b.run(colour)
        if at > width:
            raise DecodeFailed("a run leaves its row")
        edges.append(at)
        colour ^= 1
    return edges


def _two_dimensions(b: _Bits, width: int, above: list[int]) -> list[int]:
    """Changes of a row told by those of the row above it."""
    edges: list[int] = []
    at, colour = -1, 0
    while at < width:
        # The first change above, to the right, to the other colour; and the one after it.
        k = next((i for i, e in enumerate(above) if e > at and i % 2 == colour), len(above))
        b1, b2 = ([*above[k : k + 2], width, width])[:2]
        mode = b.code(MODES)
        if mode == "pass":
            at = b2
        elif mode == "across":
            start = max(at, 0)
            first = start + b.run(colour)
            at = first + b.run(colour ^ 1)
            if at > width:
                raise DecodeFailed("a run leaves its row")
            edges += [first, at]
        else:
            at = b1 + mode
            if not (edges[-1] if edges else 0) <= at <= width:
                raise DecodeFailed("a change goes back")
            edges.append(at)
            colour ^= 1
        if at >= width:
            break
    return edges


def decode(data: bytes, width: int, height: int, group: int, mixed: bool = False) -> bytes:
    """Packed rows, black as 1. ``group``: 2 for byte-aligned one-dimensional rows, 3, or 4; ``mixed``: group 3 with two-dimensional rows."""
    b, above = _Bits(data), []
    rows = np.zeros((height, width), np.uint8)
    for y in range(height):
        flat = group != 4
        if group == 3:
            # Fill bits and an end of line may come before a row.
            zeros = len(b.bits[b.at : b.at + 4096]) - len(b.bits[b.at : b.at + 4096].lstrip("0"))
            if zeros >= 11:
                b.at += zeros + 1
                if mixed:
                    flat = b.bits[b.at : b.at + 1] == "1"
                    b.at += 1
        edges = _one_dimension(b, width) if flat else _two_dimensions(b, width, above)
        for start, end in zip(edges[::2], [*edges[1::2], width][: len(edges[::2])], strict=True):
            rows[y, start:end] = 1
        above = [e for e in edges if e < width]
        if group == 2:
            b.at = -(-b.at // 8) * 8
    return np.packbits(rows, axis=1).tobytes()
