"""Packed images in numpy, and the kernels on them.

A raster is height x width x 4 unsigned bytes of straight RGBA; light is the same shape in float32.
Rounding: "half up" is floor(x + 0.5); "clamped" is to even and cut to 0..255.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field, replace

import numpy as np

# Matrices between the two colour spaces, in linear light, and luminance weights.
P3_TO_SRGB = np.array([[1.2249401763, -0.2249401763, 0.0], [-0.0420569547, 1.0420569547, 0.0], [-0.0196375546, -0.0786360456, 1.0982736001]])
SRGB_TO_P3 = np.array([[0.8224619687, 0.1775380313, 0.0], [0.0331941989, 0.9668058011, 0.0], [0.0170826307, 0.0723974407, 0.9105199286]])
LUMINANCE = np.array([0.2126, 0.7152, 0.0722])

_U = np.arange(256) / 255
LINEAR = np.where(_U <= 0.04045, _U / 12.92, ((_U + 0.055) / 1.055) ** 2.4).astype(np.float32)


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(x, np.float64) + 0.5)


def clamped(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def encode_srgb(light: np.ndarray) -> np.ndarray:
    """Linear light to sRGB bytes, half up; what is not above zero is 0."""
    x = np.clip(np.nan_to_num(np.asarray(light, np.float64), nan=0.0), 0, 1)
    return half_up(np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055) * 255).astype(np.uint8)


@dataclass
class Raster:
    data: np.ndarray
    colour_space: str = "srgb"
    has_alpha: bool = False

    @property
    def height(self) -> int:
        return self.data.shape[0]

    @property
    def width(self) -> int:
        return self.data.shape[1]

    @property
    def is_light(self) -> bool:
        return self.data.dtype != np.uint8


@dataclass
class Frame:
    image: Raster
    delay_ms: float


@dataclass
class Decoded:
    """What a reader gives: the picture upright, and what came with it."""

    image: Raster
    frames: list[Frame] = field(default_factory=list)
    loop_count: int = 0
    exif: bytes | None = None
    icc: bytes | None = None
    #: The picture of a gain map; whether an alpha plane or gain map could not be read.
    gain_map: Raster | None = None
    dropped: bool = False


def blank(width: int, height: int, colour_space: str = "srgb", has_alpha: bool = False) -> Raster:
    return Raster(np.zeros((height, width, 4), np.uint8), colour_space, has_alpha)


def opaque(rgb: np.ndarray, colour_space: str = "srgb") -> Raster:
    """A raster of height x width x 3 bytes."""
    out = np.full((*rgb.shape[:2], 4), 255, np.uint8)
    out[..., :3] = rgb
    return Raster(out, colour_space, False)


def with_alpha(rgba: np.ndarray, colour_space: str = "srgb") -> Raster:
    """A raster whose alpha counts if some pixel is translucent."""
    return Raster(rgba, colour_space, bool((rgba[..., 3] != (255 if rgba.dtype == np.uint8 else 1)).any()))


# ---------------------------------------------------------------- geometry


def crop(image: Raster, x: int, y: int, width: int, height: int) -> Raster:
    """The window; what lies outside the image is transparent black."""
    if (x, y, width, height) == (0, 0, image.width, image.height):
        return image
    out = np.zeros((height, width, 4), image.data.dtype)
    top, left = max(0, y), max(0, x)
    part = image.data[top : max(top, y + height), left : max(left, x + width)]
    out[top - y : top - y + part.shape[0], left - x : left - x + part.shape[1]] = part
    return replace(image, data=out)


def rotate(image: Raster, degrees: int) -> Raster:
    """Anticlockwise by a multiple of 90."""
    return image if degrees % 360 == 0 else replace(image, data=np.ascontiguousarray(np.rot90(image.data, degrees // 90)))


def mirror(image: Raster, axis: str | None) -> Raster:
    """``horizontal`` swaps left and right."""
    return image if not axis else replace(image, data=np.ascontiguousarray(image.data[:, ::-1] if axis == "horizontal" else image.data[::-1]))


#: EXIF orientation to (anticlockwise rotation, mirror axis); the mirror comes first.
ORIENTATIONS = {1: (0, None), 2: (0, "horizontal"), 3: (180, None), 4: (0, "vertical"), 5: (90, "horizontal"), 6: (270, None), 7: (270, "horizontal"), 8: (90, None)}


def orient(image: Raster, exif: int) -> Raster:
    degrees, axis = ORIENTATIONS.get(exif, (0, None))
    return rotate(mirror(image, axis), degrees)


def blit(target: Raster, tile: Raster, x: int, y: int) -> None:
    """Overwrites ``target`` with the part of ``tile`` that fits right and below of (x, y)."""
    height, width = max(0, min(tile.height, target.height - y)), max(0, min(tile.width, target.width - x))
    target.data[y : y + height, x : x + width] = tile.data[:height, :width]


def fit_longest_side(width: int, height: int, longest: float) -> tuple[int, int]:
    """Never larger; at least one pixel."""
    most = max(width, height)
    if not np.isfinite(longest) or longest < 1 or longest >= most:
        return width, height
    return tuple(max(1, int(half_up(n * (longest / most)))) for n in (width, height))


def footprint(size: int, to: int) -> np.ndarray:
    """to x size weights of the box filter: how much of each source cell lies in each output's footprint."""
    scale = size / to
    radius = max(scale, 1) / 2
    centre = ((np.arange(to) + 0.5) * scale)[:, None]
    s = np.arange(size)[None, :]
    return np.maximum(np.minimum(s + 1, centre + radius) - np.maximum(s, centre - radius), 0)


def resize(image: Raster, width: int, height: int) -> Raster:
    """Separable box filter on premultiplied colour, float32 between the two passes."""
    if (width, height) == (image.width, image.height):
        return image
    if width < 1 or height < 1:
        raise ValueError("a resized image has at least one pixel in each direction")
    source = image.data.astype(np.float64)
    premultiplied = source.copy()
    premultiplied[..., :3] *= source[..., 3:] * (1.0 if image.is_light else 1 / 255)
    for axis, to in ((1, width), (0, height)):
        if premultiplied.shape[axis] != to:
            weights = footprint(premultiplied.shape[axis], to)
            total = weights.sum(axis=1)
            weights = weights / np.where(total == 0, 1, total)[:, None]
            premultiplied = np.moveaxis(np.tensordot(weights, premultiplied, (1, axis)), 0, axis)
        premultiplied = premultiplied.astype(np.float32).astype(np.float64)
    alpha = premultiplied[..., 3:]
    with np.errstate(divide="ignore", invalid="ignore"):
        colour = premultiplied[..., :3] * ((1.0 if image.is_light else 255.0) / alpha)
    out = np.where(alpha > 0, np.concatenate([colour, alpha], axis=2), 0)
    return replace(image, data=out.astype(np.float32) if image.is_light else (half_up(out).astype(np.int64) & 255).astype(np.uint8))


def fit_square(image: Raster, side: int) -> Raster:
    scale = min(side / image.width, side / image.height)
    width, height = (max(1, int(half_up(n * scale))) for n in (image.width, image.height))
    out = blank(side, side, image.colour_space, True)
    scaled = resize(image, width, height)
    if (width, height) == (side, side):
        return scaled
    blit(out, scaled, (side - width) // 2, (side - height) // 2)
    return out


# ---------------------------------------------------------------- alpha, colour, light


def flatten(image: Raster, background: tuple[int, int, int] = (255, 255, 255)) -> Raster:
    if not image.has_alpha:
        return image
    a = image.data[..., 3:] / (255.0 if not image.is_light else 1.0)
    mixed = image.data[..., :3] * a + np.array(background, np.float64) * (1 - a)
    return opaque(clamped(mixed), image.colour_space)


def attach_alpha(image: Raster, alpha: Raster) -> Raster:
    """The red of ``alpha`` as alpha, pixel by pixel in reading order up to the shorter of the two."""
    out = image.data.copy()
    n = min(out.shape[0] * out.shape[1], alpha.height * alpha.width)
    out.reshape(-1, 4)[:n, 3] = alpha.data.reshape(-1, 4)[:n, 0]
    return replace(image, data=out, has_alpha=True)


def harden_alpha(image: Raster, threshold: int = 128, background: tuple[int, int, int] = (255, 255, 255)) -> Raster:
    """Pixels under the threshold are transparent black; the others are composited and opaque."""
    seen = image.data[..., 3] >= threshold
    out = flatten(replace(image, has_alpha=True), background).data
    out[~seen] = 0
    return Raster(out, image.colour_space, bool((~seen).any()))


def to_colour_space(image: Raster, to: str) -> Raster:
    if image.colour_space == to:
        return image
    matrix = P3_TO_SRGB if to == "srgb" else SRGB_TO_P3
    if image.is_light:
        out = image.data.copy()
        out[..., :3] = image.data[..., :3].astype(np.float64) @ matrix.T
        return Raster(out, to, image.has_alpha)
    out = image.data.copy()
    out[..., :3] = encode_srgb(LINEAR[image.data[..., :3]].astype(np.float64) @ matrix.T)
    return Raster(out, to, image.has_alpha)


def out_of_srgb_gamut(image: Raster) -> float:
    if image.colour_space != "display-p3":
        return 0.0
    c = LINEAR[image.data[..., :3]].astype(np.float64) @ P3_TO_SRGB.T
    return float(((c < 0) | (c > 1)).any(axis=2).mean())


def to_light(image: Raster) -> Raster:
    out = np.empty(image.data.shape, np.float32)
    out[..., :3] = LINEAR[image.data[..., :3]]
    out[..., 3] = image.data[..., 3] / 255
    return Raster(out, image.colour_space, image.has_alpha)


def tone_map(light: Raster, stops: float = 0.0, clip: bool = False) -> tuple[Raster, float]:
    """Bytes of scene light, and the white point: metered by the log average, rolled off by Reinhard's extended curve."""
    rgb = light.data[..., :3].astype(np.float64)
    lum = rgb @ LUMINANCE
    lit = lum[lum > 0]
    average = np.exp(np.log(lit + 1e-6).mean()) if lit.size else 0.18
    exposure = 0.18 / max(average, 1e-6) * 2.0**stops
    white = 1.0 if clip else max(1.0, float(np.nan_to_num(lum.max(initial=0.0)) * exposure))
    rgb = rgb * exposure
    if not clip:
        l = lum * exposure
        with np.errstate(divide="ignore", invalid="ignore"):
            rgb = rgb * np.where(l > 0, (1 + l / (white * white)) / (1 + l), 1)[..., None]
    out = np.empty(light.data.shape, np.uint8)
    out[..., :3] = encode_srgb(rgb)
    out[..., 3] = np.clip(half_up(light.data[..., 3] * 255.0), 0, 255)
    return Raster(out, light.colour_space, light.has_alpha), white


# ---------------------------------------------------------------- palettes


@dataclass
class Indexed:
    indices: np.ndarray
    palette: np.ndarray
    transparent: int
    exact: bool


def exact_palette(image: Raster, most: int = 256, threshold: int = 128) -> Indexed | None:
    """Colours in the order in which they are first seen, transparent last; None if there are more than ``most``."""
    flat = image.data.reshape(-1, 4)
    clear = flat[:, 3] < threshold
    packed = (flat[:, 0].astype(np.int64) << 16) | (flat[:, 1].astype(np.int64) << 8) | flat[:, 2]
    colours, first, inverse = np.unique(packed[~clear], return_index=True, return_inverse=True)
    if len(colours) + bool(clear.any()) > most:
        return None
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    palette = np.zeros((max(1, len(colours) + bool(clear.any())), 4), np.uint8)
    seen = colours[order]
    palette[: len(seen), 0], palette[: len(seen), 1], palette[: len(seen), 2], palette[: len(seen), 3] = seen >> 16, (seen >> 8) & 255, seen & 255, 255
    indices = np.full(len(flat), len(seen) & 255, np.uint8)
    indices[~clear] = rank[inverse]
    return Indexed(indices.reshape(image.data.shape[:2]), palette, len(seen) if clear.any() else -1, True)


def quantise(image: Raster, most: int = 256, threshold: int = 128, dither: bool = True) -> Indexed:
    """The exact palette if it fits, else median cut over 15-bit bins: half of the boxes by population, then by population times volume."""
    most = max(2, min(256, most))
    exact = exact_palette(image, most, threshold)
    if exact:
        return exact
    clear = image.data[..., 3] < threshold
    rgb = image.data[..., :3].astype(np.int64)
    seen = rgb[~clear]
    bins, inverse = np.unique(((seen >> 3) * (1024, 32, 1)).sum(axis=1), return_inverse=True)
    counts = np.bincount(inverse)
    sums = np.stack([np.bincount(inverse, seen[:, c]) for c in range(3)], axis=1)
    levels = np.stack([bins >> 10, (bins >> 5) & 31, bins & 31], axis=1)
    budget = max(1, most - bool(clear.any()))
    boxes = [np.arange(len(bins))]
    while len(boxes) < budget:
        spread = [levels[b].max(axis=0) - levels[b].min(axis=0) for b in boxes]
        people = [int(counts[b].sum()) for b in boxes]
        early = len(boxes) < max(1, budget // 2)
        scores = [0 if len(b) < 2 else n if early else n * int((s + 1).prod()) for b, n, s in zip(boxes, people, spread, strict=True)]
        k = int(np.argmax(scores))
        if not scores[k]:
            break
        r, g, b = spread[k]
        channel = 1 if 3 * g > 2 * r else 0
        channel = 2 if b > max(2 * r, 3 * g) else channel
        box = boxes[k][np.argsort(levels[boxes[k], channel], kind="stable")]
        cut = min(int(np.searchsorted(np.cumsum(counts[box]), people[k] / 2)) + 1, len(box) - 1)
        boxes[k] = box[:cut]
        boxes.append(box[cut:])
    palette = np.zeros((len(boxes) + bool(clear.any()), 4), np.uint8)
    for i, box in enumerate(boxes):
        palette[i] = [*half_up(sums[box].sum(axis=0) / counts[box].sum()), 255]
    return Indexed(map_to_palette(image, palette[: len(boxes)], threshold, dither), palette, len(boxes) if clear.any() else -1, False)


def nearest_colour(palette: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """For each row of ``colours`` the first entry of least weighted distance."""
    d = colours[:, None, :].astype(np.int64) - palette[None, :, :3].astype(np.int64)
    return (d * d * (3, 6, 1)).sum(axis=2).argmin(axis=1)


def map_to_palette(image: Raster, palette: np.ndarray, threshold: int, dither: bool) -> np.ndarray:
    """Indices by the nearest colour, one for each 15-bit bin: that of the bin's first pixel. Dithering is serpentine Floyd-Steinberg."""
    height, width = image.data.shape[:2]
    clear = image.data[..., 3] < threshold
    out = np.full((height, width), len(palette) & 255, np.uint8)
    if not dither:
        rgb = image.data[..., :3][~clear].astype(np.int64)
        bins = ((rgb >> 3) * (1024, 32, 1)).sum(axis=1)
        _, first, inverse = np.unique(bins, return_index=True, return_inverse=True)
        chosen = np.concatenate([nearest_colour(palette, rgb[first[a : a + 4096]]) for a in range(0, len(first), 4096)]) if len(first) else np.zeros(0, int)
        out[~clear] = chosen[inverse]
        return out
    if not len(palette):
        return out
    chosen = [-1] * 32768
    colours = [tuple(c) for c in palette[:, :3].tolist()]
    # The errors of this row and the next, three to a pixel, with a pixel's room at either end; they are kept in float32.
    here, below = array("f", bytes(12 * (width + 2))), array("f", bytes(12 * (width + 2)))
    for y in range(height):
        row, hidden, made = image.data[y, :, :3].tolist(), clear[y].tolist(), [len(palette) & 255] * width
        forward = y % 2 == 0
        step = 3 if forward else -3
        for x in range(width) if forward else range(width - 1, -1, -1):
            if hidden[x]:
                continue
            at = 3 * x + 3
            r, g, b = row[x]
            r, g, b = r + here[at], g + here[at + 1], b + here[at + 2]
            r = 0.0 if r < 0 else 255.0 if r > 255 else r
            g = 0.0 if g < 0 else 255.0 if g > 255 else g
            b = 0.0 if b < 0 else 255.0 if b > 255 else b
            rr, gg, bb = round(r), round(g), round(b)
            key = (rr >> 3) << 10 | (gg >> 3) << 5 | bb >> 3
            k = chosen[key]
            if k < 0:
                k = chosen[key] = int(nearest_colour(palette, np.array([[rr, gg, bb]]))[0])
            made[x] = k
            pr, pg, pb = colours[k]
            r, g, b = r - pr, g - pg, b - pb
            if r or g or b:
                ahead, behind = at + step, at - step
                here[ahead] += r * 0.4375
                here[ahead + 1] += g * 0.4375
                here[ahead + 2] += b * 0.4375
                below[behind] += r * 0.1875
                below[behind + 1] += g * 0.1875
                below[behind + 2] += b * 0.1875
                below[at] += r * 0.3125
                below[at + 1] += g * 0.3125
                below[at + 2] += b * 0.3125
                below[ahead] += r * 0.0625
                below[ahead + 1] += g * 0.0625
                below[ahead + 2] += b * 0.0625
        out[y] = made
        here, below = below, array("f", bytes(12 * (width + 2)))
    return out


def indexed_to_raster(indices: np.ndarray, palette: np.ndarray) -> Raster:
    """Looks colours up; an index past the end means the last."""
    return with_alpha(palette[np.minimum(indices, len(palette) - 1)])
