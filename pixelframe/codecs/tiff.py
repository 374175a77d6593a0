"""TIFF: strips or tiles, chunky or planar, the common compressions and sample kinds."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import DecodeFailed
from ..raster import Decoded, Raster, half_up, opaque, orient, with_alpha
from . import ccitt
from .bits import Reader, check_size, unpack_bits, unpack_packbits

#: Bytes of each field type; what is read of it.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


class Directory:
    """The fields of one directory by tag."""

    def __init__(self, data: bytes, at: int, mark: str):
        self.data, self.mark, self.fields = data, mark, {}
        if at + 2 > len(data):
            raise DecodeFailed("a directory lies outside the file")
        n = struct.unpack_from(mark + "H", data, at)[0]
        if at + 2 + 12 * n > len(data):
            raise DecodeFailed("a directory is cut off")
        for i in range(n):
            tag, kind, count = struct.unpack_from(mark + "HHI", data, at + 2 + 12 * i)
            self.fields.setdefault(tag, (kind, count, at + 10 + 12 * i))
        tail = at + 2 + 12 * n
        self.next = struct.unpack_from(mark + "I", data, tail)[0] if tail + 4 <= len(data) else 0

    def raw(self, tag: int) -> bytes | None:
        if tag not in self.fields:
            return None
        kind, count, at = self.fields[tag]
        size = _SIZES.get(kind, 0) * count
        if size > 4:
            at = struct.unpack_from(self.mark + "I", self.data, at)[0]
        if at + size > len(self.data):
            raise DecodeFailed("a field lies outside the file")
        return self.data[at : at + size]

    def values(self, tag: int) -> list | None:
        raw = self.raw(tag)
        if raw is None:
            return None
        kind, count, _ = self.fields[tag]
        if kind in (5, 10):
            pairs = struct.unpack(f"{self.mark}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        return list(struct.unpack(f"{self.mark}{count}{_CODES[kind]}", raw)) if kind in _CODES else list(raw)

    def one(self, tag: int, default: int) -> int:
        found = self.values(tag)
        return int(found[0]) if found else default


def directories(data: bytes) -> tuple[str, list[Directory]]:
    mark = {b"II": "<", b"MM": ">"}.get(data[:2])
    if mark is None or len(data) < 8:
        raise DecodeFailed("no TIFF header")
    version, at = struct.unpack_from(mark + "HI", data, 2)
    if version == 43:
        raise DecodeFailed("BigTIFF is not read")
    if version != 42:
        raise DecodeFailed("no TIFF header")
    out, seen = [], set()
    while at and at not in seen and len(out) < 1000:
        seen.add(at)
        out.append(Directory(data, at, mark))
        at = out[-1].next
    return mark, out


def _lzw(data: bytes, size: int) -> bytes:
    """Codes of growing width, highest bit first, that widen one code early."""
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, out = list(fresh), 9, None, bytearray()
    held = have = 0
    for byte in data:
        held = held << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 256:
            table, width, last = list(fresh), 9, None
            continue
        if code == 257:
            break
        if code < len(table):
            now = table[code]
        elif code == len(table) and last is not None:
            now = last + last[:1]
        else:
            raise DecodeFailed("a code is not in the table yet")
        out += now
        if last is not None:
            table.append(last + now[:1])
        last = now
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out[:size])


def _expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        out = data[:size]
    elif compression == 5:
        out = _lzw(data, size)
    elif compression in (8, 32946):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error:
            raise DecodeFailed("a strip does not inflate") from None
    elif compression == 32773:
        out = unpack_packbits(data, size)
    else:
        raise DecodeFailed(f"compression {compression} is not read")
    if len(out) < size:
        raise DecodeFailed("a strip holds fewer pixels than it says")
    return out


def _samples(d: Directory, width: int, height: int, depth: int, per: int, kind: int) -> np.ndarray:
    """height x width x per samples: integers, or floats where ``kind`` is 3."""
    planar, predictor, compression = d.one(284, 1), d.one(317, 1), d.one(259, 1)
    if predictor not in (1, 2) or planar not in (1, 2):
        raise DecodeFailed("the predictor or the layout is not read")
    tile_w, tile_h = d.one(322, 0), d.one(323, 0)
    tiled = bool(tile_w and tile_h)
    if not tiled:
        tile_w, tile_h = width, min(height, d.one(278, height) or height)
    offsets, counts = d.values(324 if tiled else 273), d.values(325 if tiled else 279)
    across, down = -(-width // tile_w), -(-height // tile_h)
    planes = per if planar == 2 else 1
    if not offsets or len(offsets) < across * down * planes:
        raise DecodeFailed("there are fewer strips than the size needs")
    counts = counts or [len(d.data)] * len(offsets)
    here = 1 if planar == 2 else per
    dtype = np.dtype({(3, 16): "f2", (3, 32): "f4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (1, 16): "u2", (1, 32): "u4"}.get((kind, depth), "u1")).newbyteorder(d.mark)
    out = np.zeros((height, width, per), dtype.newbyteorder("="))
    reverse = d.one(266, 1) == 2
    for plane in range(planes):
        for k in range(across * down):
            y, x = k // across * tile_h, k % across * tile_w
            rows = tile_h if tiled else min(tile_h, height - y)
            stride = (tile_w * here * depth + 7) // 8
            i = plane * across * down + k
            raw = d.data[offsets[i] : offsets[i] + counts[i]]
            if reverse:
                raw = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tobytes()
            if compression in (2, 3, 4):
                if depth != 1 or here != 1:
                    raise DecodeFailed("fax coding is for one bit")
                plain = ccitt.decode(raw, tile_w, rows, compression, bool(d.one(292, 0) & 1))
            else:
                plain = _expand(raw, compression, stride * rows)
            block = np.frombuffer(plain, np.uint8).reshape(rows, stride)
            if depth < 8:
                values = unpack_bits(block, depth, tile_w * here)
            else:
                values = np.ascontiguousarray(block).view(dtype)
            values = values.reshape(rows, tile_w, here)
            if predictor == 2:
                if kind == 3 or depth < 8:
                    raise DecodeFailed("the predictor does not go with the samples")
                values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
            h, w = min(rows, height - y), min(tile_w, width - x)
            out[y : y + h, x : x + w, plane if planar == 2 else slice(None)] = values[:h, :w, 0] if planar == 2 else values[:h, :w]
    return out


def _bytes_of(v: np.ndarray, depth: int, kind: int) -> np.ndarray:
    if kind == 2:
        v = v.astype(np.int64) + (1 << depth - 1)
    if depth == 16:
        return (v.astype(np.int64) >> 8).astype(np.uint8)
    if depth == 32:
        return (v.astype(np.int64) >> 24).astype(np.uint8)
    return half_up(v.astype(np.float64) * 255 / ((1 << depth) - 1)).astype(np.uint8)


def page_of(data: bytes) -> Directory:
    """The first directory that is no reduced version of another."""
    _, found = directories(data)
    if not found:
        raise DecodeFailed("there is no picture")
    return next((d for d in found if not d.one(254, 0) & 1), found[0])


def decode(data: bytes) -> Decoded:
    d = page_of(data)
    width, height = d.one(256, 0), d.one(257, 0)
    check_size(width, height)
    per, photometric = d.one(277, 1), d.one(262, 1)
    depths, kinds = d.values(258) or [1], d.values(339) or [1]
    depth, kind = depths[0], kinds[0]
    if len(set(depths)) > 1 or depth not in (1, 2, 4, 8, 16, 32) or kind not in (1, 2, 3, 4) or (kind == 3 and depth not in (16, 32)):
        raise DecodeFailed("the samples are of no known kind")
    kind = 1 if kind == 4 else kind
    colours = {0: 1, 1: 1, 2: 3, 3: 1, 4: 1, 5: 4}.get(photometric)
    if colours is None or per < colours:
        raise DecodeFailed("the colours are of no known kind")
    v = _samples(d, width, height, depth, per, kind)
    extra = d.values(338) or []
    associated = extra[0] if per > colours and extra and extra[0] in (1, 2) else 0
    if kind == 3:
        image = _from_float(v, colours, associated)
    elif photometric == 3:
        table = np.array(d.values(320) or [], np.int64)
        if len(table) < 3 << depth:
            raise DecodeFailed("the colour map is cut off")
        table = table[: 3 << depth].reshape(3, -1).T
        image = opaque((table >> 8 if table.max() > 255 else table).astype(np.uint8)[v[..., 0]])
    else:
        b = _bytes_of(v, depth, kind)
        colour = b[..., :colours]
        if photometric == 0:
            colour = 255 - colour
        if photometric == 5:
            colour = np.clip(np.rint((255.0 - colour[..., :3]) * (255.0 - colour[..., 3:]) / 255), 0, 255).astype(np.uint8)
        rgb = np.broadcast_to(colour, (height, width, 3))
        if not associated:
            image = opaque(rgb)
        else:
            alpha = b[..., colours : colours + 1]
            if associated == 1:
                with np.errstate(divide="ignore", invalid="ignore"):
                    rgb = np.where(alpha > 0, np.clip(np.rint(rgb * 255.0 / alpha), 0, 255), 0).astype(np.uint8)
            image = with_alpha(np.concatenate([rgb, alpha], axis=2))
    icc = d.raw(34675)
    return Decoded(orient(image, d.one(274, 1)), exif=data if 34665 in d.fields or 34853 in d.fields else None, icc=icc)


def _from_float(v: np.ndarray, colours: int, associated: int) -> Raster:
    """Floats within 0..1 become bytes as they stand; others are scene light."""
    out = np.ones((*v.shape[:2], 4), np.float32)
    out[..., :3] = v[..., : 3 if colours >= 3 else 1].astype(np.float32)
    if associated:
        out[..., 3] = np.clip(v[..., colours], 0, 1)
        if associated == 1:
            with np.errstate(divide="ignore", invalid="ignore"):
                out[..., :3] = np.where(out[..., 3:] > 0, out[..., :3] / out[..., 3:], 0)
    out = np.nan_to_num(out, nan=0.0)
    if out[..., :3].min() >= 0 and out[..., :3].max() <= 1:
        return with_alpha(half_up(out * 255.0).astype(np.uint8)) if associated else opaque(half_up(out[..., :3] * 255.0).astype(np.uint8))
    return Raster(out, "srgb", bool(associated) and bool((out[..., 3] < 1).any()))


#: Tags of the first directory that are carried, pointers to the directories below it, and tags that are left out there.
CARRIED = (270, 271, 272, 305, 306, 315, 33432)
_BELOW, _LEFT_OUT = (34665, 34853), (37500, 40965)
#: Field: tag, type, and values or little-endian bytes.
Field = tuple[int, int, list[int] | bytes]


def _body(field: Field) -> bytes:
    return field[2] if isinstance(field[2], bytes) else struct.pack(f"<{len(field[2])}{_CODES[field[1]]}", *field[2])


def _room(fields: list[Field]) -> int:
    """Bytes of a directory and of the values that do not fit into it."""
    return 6 + 12 * len(fields) + sum(n + n % 2 for f in fields if (n := len(_body(f))) > 4)


def _directory(fields: list[Field], at: int) -> bytes:
    """A directory that stands at ``at``, its long values behind it."""
    head, tail = bytearray(struct.pack("<H", len(fields))), bytearray()
    for field in sorted(fields, key=lambda f: f[0]):
        body = _body(field)
        head += struct.pack("<HHI", field[0], field[1], len(body) // _SIZES[field[1]])
        if len(body) > 4:
            head += struct.pack("<I", at + 6 + 12 * len(fields) + len(tail))
            tail += body + bytes(len(body) % 2)
        else:
            head += body.ljust(4, b"\0")
    return bytes(head) + bytes(4) + bytes(tail)


def _little(d: Directory, tag: int) -> Field | None:
    """A field of a directory in little-endian order; None if it is damaged or of an unknown type."""
    kind, _, _ = d.fields[tag]
    try:
        raw = d.raw(tag)
    except DecodeFailed:
        return None
    unit = {3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 5: 4, 10: 4, 12: 8}.get(kind, 1)
    if kind not in _SIZES or not raw:
        return None
    if unit > 1 and d.mark == ">":
        raw = np.frombuffer(raw, f">u{unit}").astype(f"<u{unit}").tobytes()
    return tag, kind, raw


def carried_exif(payload: bytes) -> tuple[list[Field], dict[int, list[Field]]]:
    """What of an EXIF payload goes into a TIFF: fields of the first directory, and the directories below by their pointers."""
    try:
        mark, found = directories(payload)
    except (DecodeFailed, struct.error):
        return [], {}
    if not found:
        return [], {}
    top = [f for t in CARRIED if t in found[0].fields and (f := _little(found[0], t))]
    below = {}
    for pointer in _BELOW:
        try:
            d = Directory(payload, found[0].one(pointer, 0), mark) if pointer in found[0].fields else None
        except (DecodeFailed, struct.error):
            continue
        fields = [f for t in d.fields if t not in _LEFT_OUT and (f := _little(d, t))] if d else []
        if fields:
            below[pointer] = fields
    return top, below


def encode(image: Raster, alpha: bool | None = None, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    """Little-endian strips of about 64 KiB, deflated with the horizontal predictor."""
    deep = image.has_alpha if alpha is None else alpha
    per = 4 if deep else 3
    pixels = image.data[..., :per]
    moved = pixels.copy()
    moved[:, 1:] -= pixels[:, :-1]
    lines = max(1, min(image.height, 65536 // (image.width * per)))
    strips = [zlib.compress(moved[y : y + lines].tobytes(), 6) for y in range(0, image.height, lines)]
    top, below = carried_exif(exif) if exif else ([], {})

    def fields(offsets: list[int], places: dict[int, int]) -> list[Field]:
        out: list[Field] = [
            (256, 4, [image.width]), (257, 4, [image.height]), (258, 3, [8] * per), (259, 3, [8]), (262, 3, [2]), (273, 4, offsets),
            (274, 3, [1]), (277, 3, [per]), (278, 4, [lines]), (279, 4, [len(x) for x in strips]), (284, 3, [1]), (317, 3, [2]),
        ]
        out += [(338, 3, [2])] if deep else []
        out += [(34675, 7, icc)] if icc else []
        return out + top + [(pointer, 4, [at]) for pointer, at in places.items()]

    at, places, offsets = 8 + _room(fields([0] * len(strips), dict.fromkeys(below, 0))), {}, []
    for pointer, own in below.items():
        places[pointer] = at
        at += _room(own)
    for strip in strips:
        offsets.append(at)
        at += len(strip) + len(strip) % 2
    out = b"II" + struct.pack("<HI", 42, 8) + _directory(fields(offsets, places), 8)
    out += b"".join(_directory(own, places[pointer]) for pointer, own in below.items())
    return out + b"".join(x + bytes(len(x) % 2) for x in strips)


__all__ = ["Directory", "Reader", "carried_exif", "decode", "directories", "encode", "page_of"]
