"""PNG and APNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import DecodeFailed, EncodeFailed
from ..raster import Decoded, Frame, Indexed, Raster, blank, half_up, opaque, quantise, with_alpha
from .bits import check_size, unpack_bits

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS, MOST_FRAME_PIXELS = 80_000_000, 200_000_000


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(type, body) of every chunk up to IEND."""
    if data[:8] != SIGNATURE:
        raise DecodeFailed("no PNG signature")
    at, out = 8, []
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            raise DecodeFailed("a chunk is cut off")
        out.append((kind, data[at + 8 : at + 8 + n]))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


def _header(found: list[tuple[bytes, bytes]]) -> tuple[int, int, int, int]:
    if not found or found[0][0] != b"IHDR" or len(found[0][1]) != 13:
        raise DecodeFailed("the header is missing")
    width, height, depth, colour, method, filters, interlaced = struct.unpack(">IIBBBBB", found[0][1])
    check_size(width, height, MOST_PIXELS)
    if depth not in _DEPTHS.get(colour, ()) or method or filters:
        raise DecodeFailed("the header is not legal")
    if interlaced:
        raise DecodeFailed("interlaced pictures are not read")
    return width, height, depth, colour


def _unfilter_slanted(rows: np.ndarray, step: int) -> np.ndarray:
    """As :func:`unfilter`, along diagonals: a pixel needs those to its left and above, so those of one diagonal come at once."""
    height, n = len(rows), -(-(rows.shape[1] - 1) // step)
    kinds = rows[:, 0]
    if kinds.max(initial=0) > 4:
        raise DecodeFailed("a row has no known filter")
    given = np.zeros((height, n * step), np.uint8)
    given[:, : rows.shape[1] - 1] = rows[:, 1:]
    given = given.reshape(height, n, step).astype(np.int16)
    out = np.zeros((height + 1, n + 1, step), np.int16)
    for t in range(height + n - 1):
        y = np.arange(max(0, t - n + 1), min(height, t + 1))
        x, kind = t - y, kinds[y][:, None]
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.where(kind == 4, paeth, np.where(kind == 3, (a + b) >> 1, np.where(kind == 2, b, np.where(kind == 1, a, 0))))
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)[:, : rows.shape[1] - 1]


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters of rows that begin with their filter's number."""
    if min(len(rows), rows.shape[1] // step) >= 48 and (rows[:, 0] > 2).any():
        return _unfilter_slanted(rows, step)
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for y, kind in enumerate(rows[:, 0].tolist()):
        line, above = rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            n = -(-len(line) // step) * step
            padded = np.zeros(n, np.uint8)
            padded[: len(line)] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
        elif kind in (3, 4):
            now, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(len(now)):
                a, b = now[i - step] if i >= step else 0, up[i]
                if kind == 3:
                    now[i] = (now[i] + ((a + b) >> 1)) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - c - c)
                    now[i] = (now[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[y + 1] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise DecodeFailed("a row has no known filter")
    return out[1:]


def _pixels(packed: bytes, width: int, height: int, depth: int, colour: int, plte: bytes | None, trns: bytes | None) -> Raster:
    channels = _CHANNELS[colour]
    stride = (width * channels * depth + 7) // 8
    z = zlib.decompressobj()
    try:
        raw = z.decompress(packed, (stride + 1) * height + 1)
    except zlib.error:
        raise DecodeFailed("the pixels do not inflate") from None
    if len(raw) != (stride + 1) * height:
        raise DecodeFailed("the pixels are more or fewer than the size says")
    rows = unfilter(np.frombuffer(raw, np.uint8).reshape(height, stride + 1), max(1, channels * depth // 8))
    if depth == 16:
        values = rows.reshape(height, width, channels, 2).astype(np.int64) @ (256, 1)
        samples = half_up(values * 255 / 65535).astype(np.uint8)
    else:
        values = unpack_bits(rows, depth, width * channels).reshape(height, width, channels)
        samples = values if depth == 8 else half_up(values * 255.0 / ((1 << depth) - 1)).astype(np.uint8)
    if colour == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        rgb = np.frombuffer(plte or b"", np.uint8, len(plte or b"") // 3 * 3).reshape(-1, 3)[:256]
        table[: len(rgb), :3] = rgb
        alpha = np.frombuffer((trns or b"")[:256], np.uint8)
        table[: len(alpha), 3] = alpha
        return with_alpha(table[values[..., 0]])
    rgb = np.broadcast_to(samples[..., : 3 if channels > 2 else 1], (height, width, 3))
    if colour in (4, 6):
        return with_alpha(np.concatenate([rgb, samples[..., -1:]], axis=2))
    if trns and len(trns) >= 2 * channels:
        key = np.frombuffer(trns, ">u2", channels).astype(np.int64)
        clear = (values[..., :channels].astype(np.int64) == key).all(axis=2)
        return with_alpha(np.concatenate([rgb, np.where(clear, 0, 255).astype(np.uint8)[..., None]], axis=2))
    return opaque(rgb)


def _first(found: list[tuple[bytes, bytes]], kind: bytes) -> bytes | None:
    return next((body for k, body in found if k == kind), None)


def _space(found: list[tuple[bytes, bytes]]) -> str:
    cicp = _first(found, b"cICP")
    return "display-p3" if cicp and cicp[0] == 12 else "srgb"


def decode(data: bytes) -> Decoded:
    found = chunks(data)
    width, height, depth, colour = _header(found)
    packed = b"".join(body for kind, body in found if kind == b"IDAT")
    image = _pixels(packed, width, height, depth, colour, _first(found, b"PLTE"), _first(found, b"tRNS"))
    image.colour_space = _space(found)
    return Decoded(image)


# ---------------------------------------------------------------- animation


def decode_apng(data: bytes) -> Decoded:
    """Composited frames, and the default image as the picture."""
    found = chunks(data)
    width, height, depth, colour = _header(found)
    plte, trns = _first(found, b"PLTE"), _first(found, b"tRNS")
    control = _first(found, b"acTL")
    if control is None or len(control) < 8:
        raise DecodeFailed("there is no animation control")
    n_frames, plays = struct.unpack(">II", control[:8])
    if n_frames < 1 or n_frames * width * height > MOST_FRAME_PIXELS:
        raise DecodeFailed("the animation is too large")
    parts: list[list] = []
    default, sequence = bytearray(), 0
    for kind, body in found:
        if kind in (b"fcTL", b"fdAT"):
            if len(body) < 4 or struct.unpack_from(">I", body)[0] != sequence:
                raise DecodeFailed("the sequence numbers have a gap")
            sequence += 1
        if kind == b"fcTL":
            if len(body) < 26:
                raise DecodeFailed("a frame control is cut off")
            w, h, x, y, num, den, dispose, blend = struct.unpack(">IIIIHHBB", body[4:26])
            if not w or not h or x + w > width or y + h > height or dispose > 2 or blend > 1:
                raise DecodeFailed("a frame lies outside the canvas")
            parts.append([w, h, x, y, num * 1000 / (den or 100), dispose, blend, bytearray(), not default])
        elif kind == b"IDAT":
            default += body
            if parts:
                parts[0][7] += body
        elif kind == b"fdAT":
            if not parts:
                raise DecodeFailed("frame data without a frame")
            parts[-1][7] += body[4:]
    if len(parts) != n_frames:
        raise DecodeFailed("there are more or fewer frames than are stated")
    image = _pixels(bytes(default), width, height, depth, colour, plte, trns)
    canvas, frames = np.zeros((height, width, 4), np.uint8), []
    for w, h, x, y, delay, dispose, blend, packed, _ in parts:
        tile = _pixels(bytes(packed), w, h, depth, colour, plte, trns).data
        part = canvas[y : y + h, x : x + w]
        before = part.copy()
        part[...] = over(part, tile) if blend else tile
        frames.append(Frame(with_alpha(canvas.copy()), delay))
        if dispose:
            part[...] = before if dispose == 2 else 0
    space = _space(found)
    for f in (image, *(f.image for f in frames)):
        f.colour_space = space
    return Decoded(image, frames, plays)


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """``above`` drawn over ``below``, straight alpha, half up."""
    fa, ba = above[..., 3:] / 255.0, below[..., 3:] / 255.0
    alpha = fa + ba * (1 - fa)
    with np.errstate(divide="ignore", invalid="ignore"):
        colour = (above[..., :3] * fa + below[..., :3] * ba * (1 - fa)) / alpha
    mixed = np.concatenate([half_up(colour), half_up(alpha * 255)], axis=2)
    out = np.where(alpha > 0, mixed, 0)
    out = np.where(above[..., 3:] == 255, above, np.where(above[..., 3:] == 0, below, out))
    return out.astype(np.uint8)


# ---------------------------------------------------------------- writing


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, step: int) -> bytes:
    """Each row under the filter whose bytes, read as signed, have the least sum of magnitudes; ties go to the lower number."""
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], corner[:, step:] = rows[:, :-step], above[:, :-step]
    a, b, c = (v.astype(np.int16) for v in (left, above, corner))
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
    tried = np.stack([rows, rows - left, rows - above, rows - ((a + b) >> 1).astype(np.uint8), rows - guess])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tried[best, np.arange(len(rows))]
    return out.tobytes()


def _colour_chunks(image: Raster, icc: bytes | None) -> bytes:
    if icc:
        return chunk(b"iCCP", b"ICC profile\0\0" + zlib.compress(icc))
    return chunk(b"cICP", bytes((12, 13, 0, 1))) if image.colour_space == "display-p3" else b""


def _truecolour(image: Raster, extra: bytes) -> bytes:
    channels = 4 if image.has_alpha else 3
    rows = np.ascontiguousarray(image.data[..., :channels]).reshape(image.height, -1)
    head = struct.pack(">IIBBBBB", image.width, image.height, 8, 6 if channels == 4 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(filtered(rows, channels), 6)) + chunk(b"IEND", b"")


def _indexed(image: Raster, found: Indexed, extra: bytes) -> bytes:
    palette, indices = found.palette, found.indices
    if found.transparent > 0:  # the transparent entry comes first, so that one alpha byte is enough
        order = np.r_[found.transparent, 0 : found.transparent, found.transparent + 1 : len(palette)]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        palette, indices = palette[order], back[indices].astype(np.uint8)
    depth = next(d for d in (1, 2, 4, 8) if len(palette) <= 1 << d)
    per = 8 // depth
    padded = np.zeros((image.height, -(-image.width // per) * per), np.uint8)
    padded[:, : image.width] = indices
    shifts = (np.arange(per)[::-1] * depth).astype(np.uint8)
    packed = np.bitwise_or.reduce(padded.reshape(image.height, -1, per) << shifts, axis=2)
    rows = np.concatenate([np.zeros((image.height, 1), np.uint8), packed], axis=1)
    head = struct.pack(">IIBBBBB", image.width, image.height, depth, 3, 0, 0, 0)
    clear = chunk(b"tRNS", b"\0") if found.transparent >= 0 else b""
    return SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"PLTE", palette[:, :3].tobytes()) + clear + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encode(image: Raster, palette: int | None = None, dither: bool = True, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    """Indexed where that is smaller and loses nothing, or where ``palette`` colours are asked for."""
    extra = _colour_chunks(image, icc) + (chunk(b"eXIf", exif) if exif else b"")
    if palette:
        return _indexed(image, quantise(image, palette, dither=dither), extra)
    best = _truecolour(image, extra)
    alpha = image.data[..., 3]
    if not (icc and image.colour_space == "display-p3") and ((alpha == 0) | (alpha == 255)).all() and not ((alpha == 0)[..., None] & (image.data[..., :3] != 0)).any():
        from ..raster import exact_palette

        found = exact_palette(image)
        if found:
            small = _indexed(image, found, extra)
            best = small if len(small) < len(best) else best
    return best


def delay_rational(ms: float) -> tuple[int, int]:
    """Numerator and denominator of a frame's delay: the finest denominator that fits."""
    for den in (1000, 100, 10, 1):
        num = int(half_up(ms * den / 1000))
        if num <= 65535:
            return num, den
    return 65535, 1


def encode_apng(frames: list[Frame], plays: int = 0, icc: bytes | None = None) -> bytes:
    """Whole frames, each replacing the last."""
    if not frames:
        raise EncodeFailed("an animation has a frame")
    first = frames[0].image
    deep = any(f.image.has_alpha for f in frames)
    channels = 4 if deep else 3
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", first.width, first.height, 8, 6 if deep else 2, 0, 0, 0)) + _colour_chunks(first, icc)
    out += chunk(b"acTL", struct.pack(">II", len(frames), plays))
    number = 0
    for i, f in enumerate(frames):
        if (f.image.width, f.image.height) != (first.width, first.height):
            raise EncodeFailed("the frames differ in size")
        out += chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, first.width, first.height, 0, 0, *delay_rational(f.delay_ms), 0, 0))
        number += 1
        packed = zlib.compress(filtered(np.ascontiguousarray(f.image.data[..., :channels]).reshape(first.height, -1), channels), 6)
        if i:
            out += chunk(b"fdAT", struct.pack(">I", number) + packed)
            number += 1
        else:
            out += chunk(b"IDAT", packed)
    return out + chunk(b"IEND", b"")


__all__ = ["blank", "chunk", "chunks", "decode", "decode_apng", "delay_rational", "encode", "encode_apng", "filtered", "over", "unfilter"]
