"""HEIF: the graph of items, the plan of a picture, and its assembly from decoded tiles.

No HEVC decoder is part of the library; pixels come from a tile decoder that the caller gives.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import HeifMalformed, HeifUnsupported, ImageError
from ..functions.exif import is_wide_gamut
from ..raster import Raster, attach_alpha, blank, blit, crop, mirror, resize, rotate, with_alpha
from .boxes import Box, Bytes, find, walk

MOST_TILES, MOST_PIXELS = 4096, 400_000_000
#: Types of auxiliary pictures.
_ALPHA = ("urn:mpeg:hevc:2015:auxid:1", "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha")
_GAIN = ("urn:com:apple:photo:2020:aux:hdrgainmap",)


@dataclass
class Item:
    id: int
    type: str
    hidden: bool = False
    name: str = ""
    extents: list[tuple[int, int]] = field(default_factory=list)
    method: int = 0
    properties: list[int] = field(default_factory=list)


@dataclass
class Property:
    type: str
    value: dict


@dataclass
class Meta:
    primary: int
    items: dict[int, Item]
    properties: list[Property]
    references: list[tuple[str, int, int]]
    data: bytes
    idat: tuple[int, int] | None

    def of(self, item: int, kind: str) -> dict | None:
        """The value of an item's first property of a kind."""
        for i in self.items[item].properties:
            if 1 <= i <= len(self.properties) and self.properties[i - 1].type == kind:
                return self.properties[i - 1].value
        return None

    def targets(self, kind: str, source: int) -> list[int]:
        return [b for k, a, b in self.references if k == kind and a == source]

    def sources(self, kind: str, target: int) -> list[int]:
        return [a for k, a, b in self.references if k == kind and b == target]

    def bytes_of(self, item: int) -> bytes:
        it = self.items[item]
        if it.method not in (0, 1):
            raise HeifUnsupported("items built from other items are not read")
        base, end = (0, len(self.data)) if it.method == 0 else self.idat or (0, 0)
        out = b""
        for offset, size in it.extents:
            size = size or end - base - offset
            if base + offset + size > end:
                raise HeifMalformed("an item lies outside the file")
            out += self.data[base + offset : base + offset + size]
        return out


def parse(data: bytes) -> Meta:
    """The item graph of a file's meta box."""
    meta = find(data, "meta")
    if meta is None:
        raise HeifMalformed("there is no meta box")
    inside = {b.type: b for b in walk(data, meta.body + 4, meta.end)}
    if "pitm" not in inside or "iinf" not in inside:
        raise HeifMalformed("there is no primary item")
    r = Bytes(data, inside["pitm"].body, inside["pitm"].end)
    primary = r.number(2 if r.full()[0] == 0 else 4)
    items = _infos(data, inside["iinf"])
    if "iloc" in inside:
        _locations(data, inside["iloc"], items)
    properties = _properties(data, inside["iprp"], items) if "iprp" in inside else []
    references = _references(data, inside["iref"]) if "iref" in inside else []
    if primary not in items:
        raise HeifMalformed("the primary item is missing")
    idat = inside.get("idat")
    return Meta(primary, items, properties, references, data, (idat.body, idat.end) if idat else None)


def _infos(data: bytes, b: Box) -> dict[int, Item]:
    r = Bytes(data, b.body, b.end)
    r.number(2 if r.full()[0] == 0 else 4)
    out = {}
    for e in walk(data, r.at, b.end):
        if e.type == "infe":
            q = Bytes(data, e.body, e.end)
            version, flags = q.full()
            if version >= 2:
                number = q.number(2 if version == 2 else 4)
                q.number(2)
                out[number] = Item(number, q.take(4).decode("latin-1"), bool(flags & 1), q.text())
    return out


def _locations(data: bytes, b: Box, items: dict[int, Item]) -> None:
    r = Bytes(data, b.body, b.end)
    version, _ = r.full()
    sizes = r.number(2)
    of_offset, of_length, of_base, of_index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    for _ in range(r.number(2 if version < 2 else 4)):
        number = r.number(2 if version < 2 else 4)
        method = r.number(2) & 15 if version else 0
        r.number(2)
        base, extents = r.number(of_base), []
        for _ in range(r.number(2)):
            r.number(of_index)
            extents.append((base + r.number(of_offset), r.number(of_length)))
        if number in items:
            items[number].method, items[number].extents = method, extents


def _properties(data: bytes, b: Box, items: dict[int, Item]) -> list[Property]:
    out: list[Property] = []
    for part in walk(data, b.body, b.end):
        if part.type == "ipco":
            out = [Property(p.type, _property(data, p)) for p in walk(data, part.body, part.end)]
        elif part.type == "ipma":
            r = Bytes(data, part.body, part.end)
            version, flags = r.full()
            for _ in range(r.number(4)):
                number = r.number(2 if version < 1 else 4)
                found = [r.number(2) & 0x7FFF if flags & 1 else r.number(1) & 0x7F for _ in range(r.number(1))]
                if number in items:
                    items[number].properties += found
    return out


def _property(data: bytes, p: Box) -> dict:
    r = Bytes(data, p.body, p.end)
    if p.type == "ispe":
        r.full()
        return {"width": r.number(4), "height": r.number(4)}
    if p.type == "irot":
        return {"degrees": (r.number(1) & 3) * 90}
    if p.type == "imir":
        return {"axis": "horizontal" if r.number(1) & 1 else "vertical"}
    if p.type == "hvcC":
        return {"config": data[p.body : p.end]}
    if p.type == "auxC":
        r.full()
        return {"type": r.text()}
    if p.type == "pixi":
        r.full()
        return {"bits": [r.number(1) for _ in range(r.number(1))]}
    if p.type == "clap":
        n = [struct.unpack(">i", r.take(4))[0] for _ in range(8)]
        return {k: n[2 * i] / (n[2 * i + 1] or 1) for i, k in enumerate(("width", "height", "x", "y"))}
    if p.type == "colr":
        kind = r.take(4).decode("latin-1")
        if kind == "nclx":
            return {"kind": kind, "primaries": r.number(2), "transfer": r.number(2), "matrix": r.number(2)}
        return {"kind": kind, "icc": data[r.at : p.end]}
    return {"raw": data[p.body : p.end]}


def _references(data: bytes, b: Box) -> list[tuple[str, int, int]]:
    r = Bytes(data, b.body, b.end)
    size = 2 if r.full()[0] == 0 else 4
    out = []
    for e in walk(data, r.at, b.end):
        q = Bytes(data, e.body, e.end)
        source = q.number(size)
        out += [(e.type, source, q.number(size)) for _ in range(q.number(2))]
    return out


def hevc_codec_string(config: bytes) -> str:
    """The RFC 6381 name of an HEVC configuration."""
    if len(config) < 13:
        raise HeifMalformed("the configuration is cut off")
    space, tier, profile = config[1] >> 6, config[1] >> 5 & 1, config[1] & 31
    flags = int(f"{int.from_bytes(config[2:6], 'big'):032b}"[::-1], 2)
    constraints = config[6:12].rstrip(b"\0")
    parts = ["hvc1", f"{('', 'A', 'B', 'C')[space]}{profile}", f"{flags:X}", f"{'LH'[tier]}{config[12]}", *(f"{b:X}" for b in constraints)]
    return ".".join(parts)


# ---------------------------------------------------------------- plans


@dataclass(frozen=True)
class Tile:
    x: int
    y: int
    width: int
    height: int
    item: int


@dataclass
class Plan:
    width: int
    height: int
    tiles: list[Tile]
    config: bytes
    colour_space: str
    degrees: int
    axis: str | None


@dataclass
class PicturePlan:
    picture: Plan
    alpha: Plan | None
    gain_map: Plan | None
    exif: bytes | None
    meta: Meta


def _config(meta: Meta, item: int) -> bytes:
    if meta.items[item].type == "jpeg":
        return b""
    found = meta.of(item, "hvcC")
    if meta.items[item].type not in ("hvc1", "hev1") or found is None:
        raise HeifUnsupported(f"items of type {meta.items[item].type} are not read")
    return found["config"]


def _space(meta: Meta, *items: int) -> str:
    for item in items:
        colour = meta.of(item, "colr")
        if colour:
            wide = colour.get("primaries") == 12 or (colour.get("icc") and is_wide_gamut(colour["icc"]))
            return "display-p3" if wide else "srgb"
    return "srgb"


def plan_item(meta: Meta, item: int) -> Plan:
    """How a coded item or a grid of them becomes one picture."""
    if item not in meta.items:
        raise HeifMalformed("an item is missing")
    kind = meta.items[item].type
    size = meta.of(item, "ispe")
    turn, flip = meta.of(item, "irot") or {"degrees": 0}, meta.of(item, "imir") or {"axis": None}
    if kind == "grid":
        r = Bytes(meta.bytes_of(item))
        r.number(1)
        wide = 4 if r.number(1) & 1 else 2
        rows, columns = r.number(1) + 1, r.number(1) + 1
        width, height = r.number(wide), r.number(wide)
        parts = meta.targets("dimg", item)
        if len(parts) != rows * columns or len(parts) > MOST_TILES:
            raise HeifMalformed("the grid has more or fewer tiles than places")
        tile = meta.of(parts[0], "ispe")
        if not tile:
            raise HeifMalformed("a tile has no size")
        tw, th = tile["width"], tile["height"]
        if any(meta.of(p, "ispe") != tile for p in parts) or tw * columns < width or th * rows < height:
            raise HeifMalformed("the tiles do not cover the picture")
        tiles = [Tile(k % columns * tw, k // columns * th, tw, th, p) for k, p in enumerate(parts)]
        config, space = _config(meta, parts[0]), _space(meta, item, parts[0])
    elif kind in ("iovl", "iden", "av01"):
        raise HeifUnsupported(f"items of type {kind} are not read")
    else:
        config, space = _config(meta, item), _space(meta, item)
        if not size:
            raise HeifMalformed("the picture has no size")
        width, height = size["width"], size["height"]
        tiles = [Tile(0, 0, width, height, item)]
    if width < 1 or height < 1 or width * height > MOST_PIXELS:
        raise HeifMalformed("the picture's size is out of range")
    return Plan(width, height, tiles, config, space, turn["degrees"], flip["axis"])


def plan(data: bytes) -> PicturePlan:
    """The primary picture, its alpha plane and gain map where it has them, and its EXIF payload."""
    meta = parse(data)
    picture = plan_item(meta, meta.primary)
    alpha = gain = None
    for aux in meta.sources("auxl", meta.primary):
        kind = (meta.of(aux, "auxC") or {}).get("type")
        try:
            if kind in _ALPHA and alpha is None:
                alpha = plan_item(meta, aux)
            elif kind in _GAIN and gain is None:
                gain = plan_item(meta, aux)
        except ImageError:  # what goes with a picture never costs the picture
            continue
    exif = None
    for item in meta.sources("cdsc", meta.primary):
        if meta.items.get(item) and meta.items[item].type == "Exif":
            raw = meta.bytes_of(item)
            start = 4 + int.from_bytes(raw[:4], "big") if len(raw) >= 4 else 0
            exif = raw[start:] if raw[start : start + 4] in (b"II*\0", b"MM\0*") else None
    return PicturePlan(picture, alpha, gain, exif, meta)


TileDecoder = Callable[[bytes, bytes, int, int], Raster]


def assemble(meta: Meta, p: Plan, decode: TileDecoder) -> Raster:
    """Tiles decoded by ``decode`` (configuration, bytes, width, height), placed, cut to size, mirrored and turned."""
    out = blank(p.width, p.height, p.colour_space)
    for tile in p.tiles:
        pixels = decode(p.config, meta.bytes_of(tile.item), tile.width, tile.height)
        if (pixels.width, pixels.height) != (tile.width, tile.height):
            pixels = crop(pixels, 0, 0, tile.width, tile.height)
        if tile.x < p.width and tile.y < p.height:
            blit(out, pixels, tile.x, tile.y)
    out = with_alpha(out.data, p.colour_space)
    return rotate(mirror(out, p.axis), p.degrees) if p.axis or p.degrees else out


def decode(data: bytes, tile_decoder: TileDecoder) -> tuple[Raster, Raster | None, bool]:
    """(picture, gain map, whether an alpha plane or gain map was dropped because it could not be read)."""
    found = plan(data)
    image, dropped, gain = assemble(found.meta, found.picture, tile_decoder), False, None
    if found.alpha:
        try:
            plane = assemble(found.meta, found.alpha, tile_decoder)
            if (plane.width, plane.height) != (image.width, image.height):
                plane = resize(plane, image.width, image.height)
            image = attach_alpha(image, plane)
        except ImageError:
            dropped = True
    if found.gain_map:
        try:
            gain = assemble(found.meta, found.gain_map, tile_decoder)
        except ImageError:
            dropped = True
    return image, gain, dropped
