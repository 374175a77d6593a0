"""GIF, with its LZW."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import DecodeFailed, EncodeFailed
from ..raster import Decoded, Frame, Raster, half_up, harden_alpha, quantise, with_alpha
from .bits import Reader, check_size

MOST_FRAMES, MOST_FRAME_PIXELS = 10_000, 80_000_000


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """Codes of growing width, lowest bit first, up to ``size`` bytes."""
    clear, end = 1 << bits, (1 << bits) + 1
    fresh = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table, width, last, out = list(fresh), bits + 1, None, bytearray()
    held = have = 0
    for byte in data:
        held |= byte << have
        have += 8
        while have >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            have -= width
            if code == clear:
                table, width, last = list(fresh), bits + 1, None
                continue
            if code == end:
                return bytes(out)
            if code < len(table):
                now = table[code]
            elif code == len(table) and last is not None:
                now = last + last[:1]
            else:
                raise DecodeFailed("a code is not in the table yet")
            out += now
            if last is not None and len(table) < 4096:
                table.append(last + now[:1])
            last = now
            if len(table) == 1 << width and width < 12:
                width += 1
            if len(out) >= size:
                return bytes(out[:size])
    return bytes(out)


def lzw_encode(data: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    out, held, have, width = bytearray(), 0, 0, bits + 1

    def put(code: int) -> None:
        nonlocal held, have
        held |= code << have
        have += width
        while have >= 8:
            out.append(held & 255)
            held >>= 8
            have -= 8

    put(clear)
    table: dict[tuple[int, int], int] = {}
    after, now = end + 1, -1
    for byte in data:
        known = table.get((now, byte)) if now >= 0 else byte
        if known is not None:
            now = known
            continue
        put(now)
        if after < 4096:
            table[now, byte] = after
            after += 1
            if after > 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            table, after, width = {}, end + 1, bits + 1
        now = byte
    if now >= 0:
        put(now)
    put(end)
    if have:
        out.append(held & 255)
    return bytes(out)


def _blocks(r: Reader) -> bytes:
    out = bytearray()
    while n := r.u8():
        out += r.take(n)
    return bytes(out)


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, first_only: bool = False) -> Decoded:
    r = Reader(data, what="GIF")
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise DecodeFailed("no GIF signature")
    width, height, flags, _, _ = r.read("HHBBB")
    table = _table(r, flags)
    canvas, frames, loops = None, [], 1
    delay, dispose, clear, pending = 100.0, 0, -1, None
    while True:
        if r.left < 1:
            if frames:
                break
            raise DecodeFailed("there is no picture")
        kind = r.u8()
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = r.u8()
            if label == 0xF9:
                body = _blocks(r)
                if len(body) >= 4:
                    bits, hundredths, index = struct.unpack("<BHB", body[:4])
                    delay, dispose, clear = 100.0 if hundredths <= 1 else hundredths * 10.0, bits >> 2 & 7, index if bits & 1 else -1
            elif label == 0xFF:
                name = r.take(r.u8())
                body = _blocks(r)
                if name in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 3 and body[0] == 1:
                    loops = struct.unpack_from("<H", body, 1)[0]
            else:
                _blocks(r)
            continue
        if kind != 0x2C:
            raise DecodeFailed("a block is of no known kind")
        x, y, w, h, flags = r.read("HHHHB")
        local = _table(r, flags)
        colours = local if local is not None else table
        bits = r.u8()
        if canvas is None:
            width, height = max(width, x + w), max(height, y + h)
            check_size(width, height)
            canvas = np.zeros((height, width, 4), np.uint8)
        if colours is None or not 1 <= bits <= 11 or not w or not h or x + w > width or y + h > height:
            raise DecodeFailed("a frame lies outside the screen or has no colours")
        if len(frames) >= min(MOST_FRAMES, MOST_FRAME_PIXELS // (width * height)):
            raise DecodeFailed("the animation is too large")
        indices = lzw_decode(_blocks(r), bits, w * h)
        if len(indices) < w * h:
            raise DecodeFailed("a frame holds fewer pixels than it says")
        index = np.frombuffer(indices, np.uint8).reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(index)
            straight[_interlaced(h)] = index
            index = straight
        if pending is not None:
            px, py, pw, ph, saved = pending
            canvas[py : py + ph, px : px + pw] = 0 if saved is None else saved
        part = canvas[y : y + h, x : x + w]
        pending = (x, y, w, h, None) if dispose == 2 else (x, y, w, h, part.copy()) if dispose == 3 else None
        drawn = index != clear
        if (index[drawn] >= len(colours)).any():
            raise DecodeFailed("a pixel is outside the colour table")
        part[drawn, :3] = colours[index[drawn]]
        part[drawn, 3] = 255
        frames.append(Frame(with_alpha(canvas.copy()), delay))
        delay, dispose, clear = 100.0, 0, -1
        if first_only:
            break
    if not frames:
        raise DecodeFailed("there is no picture")
    return Decoded(frames[0].image, frames if len(frames) > 1 else [], loops)


def _table(r: Reader, flags: int) -> np.ndarray | None:
    return np.frombuffer(r.take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3) if flags & 0x80 else None


def hundredths(ms: float) -> int:
    return int(np.clip(half_up(ms / 10), 0, 65535))


def encode(frames: list[Frame], loops: int = 0, palette: int = 256, dither: bool = True, background: tuple[int, int, int] = (255, 255, 255)) -> bytes:
    """Each frame with its own colour table, alpha hardened; frames clear what was before where they are translucent."""
    if not frames:
        raise EncodeFailed("a GIF has a frame")
    first = frames[0].image
    if first.width > 65535 or first.height > 65535:
        raise EncodeFailed("a GIF has at most 65535 pixels in each direction")
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", first.width, first.height, 0x70, 0, 0))
    moving = len(frames) > 1
    if moving and loops != 1:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", min(65535, loops)) + b"\0"
    for f in frames:
        found = quantise(harden_alpha(f.image, background=background) if f.image.has_alpha else f.image, palette, dither=dither)
        n = max(2, len(found.palette))
        bits = max(1, (n - 1).bit_length())
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(found.palette)] = found.palette[:, :3]
        if moving or found.transparent >= 0:
            flags = (8 if moving and f.image.has_alpha else 4 if moving else 0) | (found.transparent >= 0)
            out += b"\x21\xf9\x04" + struct.pack("<BHB", flags, hundredths(f.delay_ms) if moving else 0, max(0, found.transparent)) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, f.image.width, f.image.height, 0x80 | bits - 1) + table.tobytes()
        code = max(2, bits)
        packed = lzw_encode(found.indices.tobytes(), code)
        out.append(code)
        for at in range(0, len(packed), 255):
            piece = packed[at : at + 255]
            out += bytes((len(piece),)) + piece
        out.append(0)
    return bytes(out) + b"\x3b"


__all__ = ["Raster", "decode", "encode", "hundredths", "lzw_decode", "lzw_encode"]
