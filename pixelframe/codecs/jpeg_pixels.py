"""JPEG pixels: a reader of sequential and progressive Huffman files of 8 bits, and a sequential writer.

Only the entropy-coded bits are walked one by one; transforms, upsampling and colour run over all blocks at once, and so
does the whole of the writer. Files with arithmetic coding, lossless ones and 12-bit samples are refused.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

from ..errors import DecodeFailed
from ..raster import Decoded, Raster, opaque, orient
from . import jpeg
from .bits import check_size

# Quantisation tables of quality 50, by rows, and the order of coefficients along diagonals.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *(99,) * 32)
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    #: Blocks that the picture needs and that whole units have, and the coefficients in file order, 64 to a block.
    across: int = 0
    down: int = 0
    wide: int = 0
    high: int = 0
    values: list[int] = field(default_factory=list)
    dc: int = 0


class Bits:
    """The bits of one run between restart marks; past its end there are zeros, but not many."""

    __slots__ = ("acc", "at", "data", "left", "over")

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.left, self.over = data, 0, 0, 0, 0

    def fill(self) -> None:
        piece = self.data[self.at : self.at + 8]
        self.at += 8
        if len(piece) < 8:
            self.over += 8 - len(piece)
            if self.over > 64:
                raise DecodeFailed("the scan ends early")
            piece += bytes(8 - len(piece))
        self.acc = (self.acc & ((1 << self.left) - 1)) << 64 | int.from_bytes(piece, "big")
        self.left += 64

    def symbol(self, table: list[int]) -> int:
        if self.left < 16:
            self.fill()
        found = table[(self.acc >> (self.left - 16)) & 0xFFFF]
        if not found:
            raise DecodeFailed("a code is unknown")
        self.left -= found >> 8
        return found & 255

    def take(self, n: int) -> int:
        if self.left < n:
            self.fill()
        self.left -= n
        return (self.acc >> self.left) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        """A number of ``n`` bits, negative where the first is 0."""
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """By 16 bits: the length of the code that they begin with, and its symbol; 0 if there is none."""
    table, code, at = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low, high = code << (16 - length), (code + 1) << (16 - length)
            if high > 65536 or at >= len(symbols):
                raise DecodeFailed("a Huffman table is not legal")
            table[low:high] = [length << 8 | symbols[at]] * (high - low)
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _runs(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded runs from ``at`` on, stuffing removed, and where the next marker is."""
    runs, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            at = len(data)
            break
        follow = data[at + 1]
        if follow == 0:
            at += 2
        elif 0xD0 <= follow <= 0xD7:
            runs.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at = at + 2
        elif follow == 0xFF:
            at += 1
        else:
            break
    runs.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
    return runs, at


class Reader:
    def __init__(self, data: bytes):
        self.data, self.quant, self.dc, self.ac = data, {}, {}, {}
        self.parts: list[Component] = []
        self.interval, self.adobe, self.progressive, self.eob = 0, None, False, 0
        self.width = self.height = 0

    def read(self) -> Reader:
        data, at, scans = self.data, 2, 0
        if data[:2] != b"\xff\xd8":
            raise DecodeFailed("no JPEG signature")
        while at + 2 <= len(data):
            if data[at] != 0xFF:
                raise DecodeFailed("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            if marker == 1 or 0xD0 <= marker <= 0xD8:
                at += 2
                continue
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if n < 2 or len(body) != n - 2:
                raise DecodeFailed("a segment is cut off")
            at += 2 + n
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body, marker == 0xC2)
            elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
                raise DecodeFailed("this kind of JPEG is not read")
            elif marker == 0xDD and len(body) >= 2:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker == 0xDA:
                at = self._scan(body, at)
                scans += 1
        if not self.parts or not scans:
            raise DecodeFailed("there is no picture")
        return self

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            if len(body) < at + 1 + n:
                raise DecodeFailed("a quantisation table is cut off")
            self.quant[k] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float64)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            kind, counts = body[at], body[at + 1 : at + 17]
            n = sum(counts)
            (self.ac if kind >> 4 else self.dc)[kind & 15] = _lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        if self.parts:
            raise DecodeFailed("there are two frames")
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3, 4) or len(body) < 6 + 3 * n:
            raise DecodeFailed("the frame is not read")
        check_size(self.width, self.height)
        self.progressive = progressive
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in self.parts):
            raise DecodeFailed("the sampling is not legal")
        self.h, self.v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.units = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.parts:
            c.across, c.down = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.wide, c.high = self.units[0] * c.h, self.units[1] * c.v
            c.values = [0] * (64 * c.wide * c.high)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0] if body else 0
        if not 1 <= n <= 4 or len(body) < 4 + 2 * n or not self.parts:
            raise DecodeFailed("a scan is not legal")
        named = {c.id: c for c in self.parts}
        chosen = []
        for i in range(n):
            c = named.get(body[1 + 2 * i])
            if c is None:
                raise DecodeFailed("a scan names no component")
            chosen.append((c, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        runs, end = _runs(self.data, at)
        if self.progressive:
            if first > last or last > 63 or (first and n > 1):
                raise DecodeFailed("a scan is not legal")
            block = self._dc(high, low) if not first else self._ac_refine(first, last, low) if high else self._ac_first(first, last, low)
        else:
            block = self._whole
        order = list(self._order(chosen))
        units = len(order) // self._per_unit(chosen)
        step = (self.interval or units) * self._per_unit(chosen)
        for k, run in enumerate(runs[: -(-len(order) // step)]):
            for c in self.parts:
                c.dc = 0
            self.eob, bits = 0, Bits(run)
            for c, where, dc, ac in order[k * step : (k + 1) * step]:
                block(bits, c, where, dc, ac)
        if len(runs) * step < len(order):
            raise DecodeFailed("the scan ends early")
        return end

    def _per_unit(self, chosen: list) -> int:
        return sum(c.h * c.v for c, _, _ in chosen) if len(chosen) > 1 else 1

    def _order(self, chosen: list):
        """(component, place of its coefficients, tables) of the blocks as they come."""
        tables = [(c, self.dc.get(d), self.ac.get(a)) for c, d, a in chosen]
        if len(chosen) == 1:
            c, dc, ac = tables[0]
            for y in range(c.down):
                for x in range(c.across):
                    yield c, 64 * (y * c.wide + x), dc, ac
            return
        for uy in range(self.units[1]):
            for ux in range(self.units[0]):
                for c, dc, ac in tables:
                    for y in range(uy * c.v, uy * c.v + c.v):
                        for x in range(ux * c.h, ux * c.h + c.h):
                            yield c, 64 * (y * c.wide + x), dc, ac

    def _whole(self, bits: Bits, c: Component, where: int, dc: list[int] | None, ac: list[int] | None) -> None:
        if dc is None or ac is None:
            raise DecodeFailed("a Huffman table is missing")
        c.dc += bits.signed(bits.symbol(dc) & 15)
        values = c.values
        values[where] = c.dc
        k = 1
        while k < 64:
            if bits.left < 16:
                bits.fill()
            found = ac[(bits.acc >> (bits.left - 16)) & 0xFFFF]
            if not found:
                raise DecodeFailed("a code is unknown")
            bits.left -= found >> 8
            n = found & 15
            if n:
                k += (found >> 4) & 15
                if k > 63:
                    raise DecodeFailed("a run is too long")
                if bits.left < n:
                    bits.fill()
                bits.left -= n
                v = (bits.acc >> bits.left) & ((1 << n) - 1)
                values[where + k] = v if v >> (n - 1) else v - (1 << n) + 1
                k += 1
            elif found & 0xF0 == 0xF0:
                k += 16
            else:
                return

    def _dc(self, high: int, low: int):
        def block(bits: Bits, c: Component, where: int, dc: list[int] | None, ac: list[int] | None) -> None:
            if high:
                c.values[where] |= bits.take(1) << low
                return
            if dc is None:
                raise DecodeFailed("a Huffman table is missing")
            c.dc += bits.signed(bits.symbol(dc) & 15)
            c.values[where] = c.dc << low

        return block

    def _ac_first(self, first: int, last: int, low: int):
        def block(bits: Bits, c: Component, where: int, dc: list[int] | None, ac: list[int] | None) -> None:
            if self.eob:
                self.eob -= 1
                return
            if ac is None:
                raise DecodeFailed("a Huffman table is missing")
            k = first
            while k <= last:
                found = bits.symbol(ac)
                run, n = found >> 4, found & 15
                if n:
                    k += run
                    if k > last:
                        raise DecodeFailed("a run is too long")
                    c.values[where + k] = bits.signed(n) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    self.eob = (1 << run) + (bits.take(run) if run else 0) - 1
                    return

        return block

    def _ac_refine(self, first: int, last: int, low: int):
        one = 1 << low

        def mend(bits: Bits, values: list[int], at: int) -> None:
            """One more bit of a coefficient that is there already."""
            if bits.take(1) and not abs(values[at]) & one:
                values[at] += one if values[at] > 0 else -one

        def block(bits: Bits, c: Component, where: int, dc: list[int] | None, ac: list[int] | None) -> None:
            if ac is None:
                raise DecodeFailed("a Huffman table is missing")
            values, k = c.values, first
            if not self.eob:
                while k <= last:
                    found = bits.symbol(ac)
                    run, n = found >> 4, found & 15
                    new = 0
                    if n:
                        new = one if bits.take(1) else -one
                    elif run < 15:
                        self.eob = (1 << run) + (bits.take(run) if run else 0)
                        break
                    while k <= last:
                        if values[where + k]:
                            mend(bits, values, where + k)
                        elif run == 0:
                            if new:
                                values[where + k] = new
                            k += 1
                            break
                        else:
                            run -= 1
                        k += 1
            if self.eob:
                while k <= last:
                    if values[where + k]:
                        mend(bits, values, where + k)
                    k += 1
                self.eob -= 1

        return block

    def plane(self, c: Component) -> np.ndarray:
        """The component's samples at its own size, 0 to 255."""
        if c.table not in self.quant:
            raise DecodeFailed("a quantisation table is missing")
        flat = np.array(c.values, np.float64).reshape(-1, 64) * self.quant[c.table]
        blocks = np.zeros_like(flat)
        blocks[:, ZIGZAG] = flat
        made = _DCT.T @ blocks.reshape(-1, 8, 8) @ _DCT
        made = np.clip(np.rint(made + 128), 0, 255).astype(np.int32)
        whole = made.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
        return whole[: -(-self.height * c.v // self.v), : -(-self.width * c.h // self.h)]

    def planes(self) -> list[np.ndarray]:
        return [self._spread(self.plane(c), self.h / c.h, self.v / c.v) for c in self.parts]

    def _spread(self, plane: np.ndarray, across: float, down: float) -> np.ndarray:
        """To full size: triangles for a factor of two if there are more than two samples in a row, else copies."""
        wide = plane.shape[1] > 2
        if wide and (across, down) == (2, 1):
            plane = _twice(plane * 4, 2) >> 2
        elif wide and (across, down) == (2, 2):
            plane = _twice(_twice(plane.T * 4, 0).T, 3, 8, 7) >> 4
        elif (across, down) != (1, 1):
            rows = (np.arange(self.height) / down).astype(int).clip(0, plane.shape[0] - 1)
            plane = plane[rows][:, (np.arange(self.width) / across).astype(int).clip(0, plane.shape[1] - 1)]
        return plane[: self.height, : self.width]

    def rgb(self) -> np.ndarray:
        p = self.planes()
        if len(p) == 1:
            return np.repeat(p[0][..., None], 3, axis=2).astype(np.uint8)
        plain = self.adobe == 0 or (self.adobe is None and (len(p) == 4 or [c.id for c in self.parts] == [82, 71, 66]))
        rgb = np.stack(p[:3], axis=2)
        if not plain:
            y, cb, cr = (x.astype(np.float64) for x in p[:3])
            cb, cr = cb - 128, cr - 128
            rgb = np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)), 0, 255)
        if len(p) == 4:  # inks, as the writers that mark them store them: inverted
            inks = rgb if self.adobe is not None else 255 - rgb
            rgb = np.rint(inks * (p[3] if self.adobe is not None else 255 - p[3])[..., None] / 255)
        return rgb.astype(np.uint8)


def _twice(plane: np.ndarray, kind: int, even: int = 1, odd: int = 2) -> np.ndarray:
    """Along rows: every sample twice, three quarters of it and a quarter of its neighbour's on that side.

    ``kind`` 2: samples come times four and are rounded by ``even`` and ``odd``. 0: times four in, times four out, exactly.
    3: times four in, times sixteen out, with the rounding added.
    """
    scale = 4 if kind != 3 else 1
    x = plane // scale
    left, right = np.concatenate([x[:, :1], x[:, :-1]], axis=1), np.concatenate([x[:, 1:], x[:, -1:]], axis=1)
    add = (0, 0) if kind == 0 else (even, odd)
    out = np.empty((x.shape[0], 2 * x.shape[1]), x.dtype)
    out[:, ::2], out[:, 1::2] = 3 * x + left + add[0], 3 * x + right + add[1]
    if kind == 2:  # the rims are their samples
        out[:, 0], out[:, -1] = 4 * x[:, 0], 4 * x[:, -1]
    return out


def decode(data: bytes) -> Decoded:
    """The picture, upright as its EXIF says, in the space of its profile, with its metadata."""
    from ..functions.exif import is_wide_gamut, summary

    payload, profile = jpeg.exif(data), jpeg.icc(data)
    image = opaque(Reader(data).read().rgb(), "display-p3" if profile and is_wide_gamut(profile) else "srgb")
    turned = summary(payload).orientation if payload and payload[:4] in (b"II*\0", b"MM\0*") else None
    return Decoded(orient(image, turned or 1), exif=payload, icc=profile)


def decode_preview(data: bytes) -> Decoded:
    """The largest JPEG that lies whole in another file, such as a camera's raw file."""
    return decode(jpeg.best_preview(data))


# ---------------------------------------------------------------- writing


def quantisation(base: tuple[int, ...], quality: int) -> np.ndarray:
    """The table of a quality from 1 to 100, by rows."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths, 16 at most, of a prefix code for the symbols that occur; no code is all ones."""
    symbols = [int(s) for s in np.flatnonzero(counts)]
    # One more symbol that is rarer than all others takes the longest code.
    weights = {s: int(counts[s]) * 2 for s in symbols} | {256: 1}
    while True:
        heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))]
        heapq.heapify(heap)
        depth, fresh = dict.fromkeys(weights, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], fresh, a[2] + b[2]))
            fresh += 1
        if max(depth.values()) <= 16:
            longest = max((s for s in symbols), key=lambda s: depth[s])
            depth[256], depth[longest] = max(depth.values()), min(depth[longest], depth[256]) if depth[256] < depth[longest] else depth[longest]
            return {s: depth[s] for s in symbols}
        weights = {s: w // 2 + 1 for s, w in weights.items()}  # flatter, until no code is too long


def _table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A Huffman table as stored, and code and length by symbol."""
    lengths = code_lengths(counts)
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    stored = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(ordered)
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, before = 0, 0
    for s in ordered:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], sizes[s] = code, before
        code += 1
    return stored, codes, sizes


def _entries(zz: np.ndarray, diff: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order key, is DC, symbol, extra bits, their number) of the blocks' codes; ``zz`` n x 64 along diagonals, DC as differences."""
    n = len(zz)
    width = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    extra = lambda v, w: np.where(v < 0, v + (np.int64(1) << w) - 1, v)
    block, k = np.nonzero(zz[:, 1:])
    k = k + 1
    v = zz[block, k].astype(np.int64)
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = k - np.where(first, 0, np.concatenate([[0], k[:-1]])[: len(k)]) - 1
    long = run // 16
    zb, zk = np.repeat(block, long), np.repeat(k, long)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, k)
    ends = np.flatnonzero(last < 63)
    dw, w = width(diff), width(v)
    nothing = np.zeros(len(zb) + len(ends), np.int64)
    key = np.concatenate([np.arange(n) * 256, block * 256 + 2 * k + 1, zb * 256 + 2 * zk, ends * 256 + 200])
    symbol = np.concatenate([dw, (run % 16) << 4 | w, np.full(len(zb), 0xF0), np.zeros(len(ends), np.int64)])
    return key, np.concatenate([np.ones(n, bool), np.zeros(len(key) - n, bool)]), symbol, np.concatenate([extra(diff, dw), extra(v, w), nothing]), np.concatenate([dw, w, nothing])


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of given bit lengths one after another, filled up with ones."""
    bits = []
    for at in range(0, len(values), 1 << 18):
        v, s = values[at : at + (1 << 18)], sizes[at : at + (1 << 18)]
        ends = np.cumsum(s)
        each = np.repeat(np.arange(len(s)), s)
        bits.append(((v[each] >> (ends[each] - 1 - np.arange(len(each)))) & 1).astype(np.uint8))
    whole = np.concatenate([*bits, np.ones(-sum(map(len, bits)) % 8, np.uint8)]) if bits else np.zeros(0, np.uint8)
    return np.packbits(whole).tobytes()


def encode(image: Raster, quality: int = 92, exif: bytes | None = None, icc: bytes | None = None) -> bytes:
    """Sequential, full colour resolution, with Huffman tables of the picture's own."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be from 1 to 100")
    height, width = image.height, image.width
    if max(height, width) > 65535:
        raise ValueError("the picture is too large for the format")
    rgb = np.pad(image.data[..., :3], ((0, -height % 8), (0, -width % 8), (0, 0)), "edge").astype(np.float64)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    tables = [quantisation(LUMA, quality), quantisation(CHROMA, quality)]
    zz = []
    for i, plane in enumerate(planes):
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        made = (_DCT @ blocks @ _DCT.T).reshape(-1, 64)
        zz.append(np.rint(made / tables[min(i, 1)])[:, ZIGZAG].astype(np.int32))
    n = len(zz[0])
    streams, head = [], b""
    for i in range(3):
        key, is_dc, symbol, extra, size = _entries(zz[i], np.diff(zz[i][:, 0].astype(np.int64), prepend=0))
        streams.append((key // 256 * 3 * 256 + i * 256 + key % 256, is_dc, symbol, extra, size))
    codes = np.zeros((2, 2, 256), np.int64), np.zeros((2, 2, 256), np.int64)
    for chroma in range(2):
        for dc in range(2):
            picked = np.concatenate([s[2][s[1] == bool(dc)] for s in (streams[1:] if chroma else streams[:1])])
            stored, c, z = _table(np.bincount(picked, minlength=256))
            codes[0][chroma, dc], codes[1][chroma, dc] = c, z
            head += _segment(0xC4, bytes(((0 if dc else 16) + chroma,)) + stored)
    key = np.concatenate([s[0] for s in streams])
    order = np.argsort(key, kind="stable")
    chroma = np.concatenate([np.full(len(s[0]), int(i > 0)) for i, s in enumerate(streams)])[order]
    is_dc, symbol, extra, size = (np.concatenate([s[j] for s in streams])[order] for j in range(1, 5))
    code, length = codes[0][chroma, is_dc.astype(int), symbol], codes[1][chroma, is_dc.astype(int), symbol]
    scan = _packed(code << size | extra, length + size).replace(b"\xff", b"\xff\x00") if n else b""
    start = _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    start += b"".join(_segment(0xDB, bytes((k,)) + bytes(t[ZIGZAG].astype(np.uint8))) for k, t in enumerate(tables))
    start += _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1)))
    out = b"\xff\xd8" + start + head + _segment(0xDA, bytes((3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0))) + scan + b"\xff\xd9"
    return jpeg.with_metadata(out, exif, icc)


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes((marker,)) + struct.pack(">H", len(body) + 2) + body
