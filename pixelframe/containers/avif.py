"""AVIF: AV1 headers, and the container around coded frames that the caller gives."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..errors import EncodeFailed
from ..raster import half_up
from .boxes import box, full_box

_SEQUENCE, _DELIMITER = 1, 2


@dataclass(frozen=True)
class Obu:
    type: int
    raw: bytes
    body: bytes


def leb128(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(8):
        if at + i >= len(data):
            break
        value |= (data[at + i] & 127) << 7 * i
        if not data[at + i] & 128:
            return value, at + i + 1
    raise EncodeFailed("a length does not end")


def obus(data: bytes) -> list[Obu]:
    out, at = [], 0
    while at < len(data):
        head = data[at]
        if head & 0x80:
            raise EncodeFailed("a unit has a forbidden bit")
        body = at + 1 + (head >> 2 & 1)
        size = len(data) - body
        if head & 2:
            size, body = leb128(data, body)
        if body + size > len(data):
            raise EncodeFailed("a unit is cut off")
        out.append(Obu(head >> 3 & 15, data[at : body + size], data[body : body + size]))
        at = body + size
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def __call__(self, n: int) -> int:
        if n > self.left:
            raise EncodeFailed("the sequence header is cut off")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def uvlc(self) -> int:
        zeros = 0
        while not self(1):
            zeros += 1
        return 0xFFFFFFFF if zeros >= 32 else self(zeros) + (1 << zeros) - 1


@dataclass(frozen=True)
class Sequence:
    profile: int
    level: int
    tier: int
    high_depth: bool
    twelve: bool
    mono: bool
    sub_x: int
    sub_y: int
    position: int
    width: int
    height: int


def sequence_header(body: bytes) -> Sequence:
    """What a configuration box and a size check need of an AV1 sequence header."""
    b = _Bits(body)
    profile, _, reduced = b(3), b(1), b(1)
    level = tier = 0
    if reduced:
        level = b(5)
    else:
        decoder_model, delay_bits = 0, 0
        if b(1):  # timing
            b(32), b(32)
            if b(1):
                b.uvlc()
            decoder_model = b(1)
            if decoder_model:
                delay_bits = b(5) + 1
                b(32), b(5), b(5)
        display = b(1)
        for i in range(b(5) + 1):
            b(12)
            this = b(5)
            high = b(1) if this > 7 else 0
            level, tier = (this, high) if i == 0 else (level, tier)
            if decoder_model and b(1):
                b(delay_bits), b(delay_bits), b(1)
            if display and b(1):
                b(4)
    wide, tall = b(4) + 1, b(4) + 1
    width, height = b(wide) + 1, b(tall) + 1
    if not reduced and b(1):
        b(4), b(3)
    b(3)
    if not reduced:
        b(4)
        order = b(1)
        if order:
            b(2)
        choose = 2 if b(1) else b(1)
        if choose > 0 and not b(1):
            b(1)
        if order:
            b(3)
    b(3)
    high = b(1)
    twelve = b(1) if profile == 2 and high else 0
    mono = b(1) if profile != 1 else 0
    primaries = transfer = matrix = 2
    if b(1):
        primaries, transfer, matrix = b(8), b(8), b(8)
    sub_x = sub_y = 1
    position = 0
    if mono:
        b(1)
    elif (primaries, transfer, matrix) == (1, 13, 0):
        sub_x = sub_y = 0
    else:
        b(1)
        if profile == 1:
            sub_x = sub_y = 0
        elif profile == 2:
            sub_x = b(1) if twelve else 1
            sub_y = (b(1) if sub_x else 0) if twelve else 0
        if sub_x and sub_y:
            position = b(2)
    return Sequence(profile, level, tier, bool(high), bool(twelve), bool(mono), sub_x, sub_y, position, width, height)


def configuration(s: Sequence, header: bytes) -> bytes:
    """The av1C box's content."""
    third = s.tier << 7 | s.high_depth << 6 | s.twelve << 5 | s.mono << 4 | s.sub_x << 3 | s.sub_y << 2 | s.position
    return bytes((0x81, s.profile << 5 | s.level, third, 0)) + header


def codec_string(s: Sequence) -> str:
    return f"av01.{s.profile}.{s.level:02d}{'MH'[s.tier]}.{12 if s.twelve else 10 if s.high_depth else 8:02d}"


def rate_for(width: int, height: int, quality: float = 0.6) -> tuple[int, int]:
    """(quantizer 0..63, bits a second) of a quality from 0 to 1."""
    q = min(max(quality, 0.0), 1.0)
    return int(half_up((1 - q) * 63)), int(max(100_000, half_up(width * height * 0.05 * 40**q)))


def mux(width: int, height: int, colour: bytes, alpha: bytes | None = None, exif: bytes | None = None, icc: bytes | None = None, wide_gamut: bool = False) -> bytes:
    """One coded frame, with a hidden alpha frame and metadata where given, as a file."""
    properties: list[bytes] = []

    def place(p: bytes) -> int:
        """The number of a property; equal ones are kept once."""
        if p not in properties:
            properties.append(p)
        return properties.index(p) + 1

    def coded(frame: bytes, channels: int) -> tuple[bytes, list[tuple[int, bool]]]:
        units = [u for u in obus(frame) if u.type != _DELIMITER]
        head = next((u for u in units if u.type == _SEQUENCE), None)
        if head is None:
            raise EncodeFailed("a frame has no sequence header")
        found = [(place(full_box("ispe", 0, 0, struct.pack(">II", width, height))), False), (place(full_box("pixi", 0, 0, bytes((channels, *[8] * channels)))), False)]
        return b"".join(u.raw for u in units), [*found, (place(box("av1C", configuration(sequence_header(head.body), head.raw))), True)]

    body, mine = coded(colour, 3)
    tint = box("colr", b"prof" + icc) if icc else box("colr", b"nclx" + struct.pack(">HHHB", 12 if wide_gamut else 1, 13, 6, 0x80))
    mine.append((place(tint), False))
    payloads, infos, links, owned = [body], [(1, b"av01", 0)], [], [(1, mine)]
    if alpha is not None:
        plane, its = coded(alpha, 1)
        its.append((place(full_box("auxC", 0, 0, b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")), True))
        number = len(payloads) + 1
        payloads.append(plane)
        infos.append((number, b"av01", 1))
        links.append(("auxl", number))
        owned.append((number, its))
    if exif is not None:
        number = len(payloads) + 1
        payloads.append(bytes(4) + exif)
        infos.append((number, b"Exif", 1))
        links.append(("cdsc", number))

    def meta(offsets: list[int]) -> bytes:
        entries = b"".join(full_box("infe", 2, hidden, struct.pack(">HH", n, 0) + kind + b"\0") for n, kind, hidden in infos)
        places = b"".join(struct.pack(">HHHII", n + 1, 0, 1, o, len(p)) for n, (o, p) in enumerate(zip(offsets, payloads, strict=True)))
        owners = b"".join(struct.pack(">HB", n, len(ps)) + bytes(i | (128 if must else 0) for i, must in ps) for n, ps in owned)
        parts = [full_box("hdlr", 0, 0, bytes(4) + b"pict" + bytes(13)), full_box("pitm", 0, 0, struct.pack(">H", 1)), full_box("iloc", 0, 0, struct.pack(">HH", 0x4400, len(payloads)) + places)]
        parts += [full_box("iinf", 0, 0, struct.pack(">H", len(infos)) + entries)]
        if links:
            parts.append(full_box("iref", 0, 0, *(box(kind, struct.pack(">HHH", n, 1, 1)) for kind, n in links)))
        parts.append(box("iprp", box("ipco", *properties), full_box("ipma", 0, 0, struct.pack(">I", len(owned)) + owners)))
        return full_box("meta", 0, 0, *parts)

    head = box("ftyp", b"avif", bytes(4), b"avifmif1miaf")
    at = len(head) + len(meta([0] * len(payloads))) + 8
    offsets = []
    for p in payloads:
        offsets.append(at)
        at += len(p)
    return head + meta(offsets) + box("mdat", *payloads)
