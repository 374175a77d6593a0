"""Codecs by format and priority, and the ladder that tries them.

A registry is a plain object: it travels to the executors with the function that uses it. A codec of lower priority
number is tried first; equal ones in the order in which they came.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .codecs import bmp, dds, exr, farbfeld, gif, hdr, icns, ico, jpeg_pixels, pcx, png, pnm, psd, qoi, ras, tga, tiff, xbm, xpm
from .containers import heif
from .errors import DecodeFailed, EncodeFailed, EncodeUnsupported, ImageError, TooLarge, UnsupportedHere
from .raster import Decoded, Frame, Raster, flatten


@dataclass(frozen=True)
class Options:
    """What an encoder may be told."""

    palette: int | None = None
    dither: bool = True
    background: tuple[int, int, int] = (255, 255, 255)
    icc: bytes | None = None
    exif: bytes | None = None
    name: str = "image"
    quality: int = 92


@dataclass(frozen=True)
class Decoder:
    id: str
    format: str
    decode: Callable[[bytes], Raster | Decoded]
    path: str = "pure"
    priority: int = 40
    available: Callable[[], bool] = lambda: True
    #: Whether it gives light; such decoders of a format are tried before those that give bytes.
    light: bool = False


@dataclass(frozen=True)
class Encoder:
    id: str
    format: str
    encode: Callable[[Decoded, Options], bytes]
    path: str = "pure"
    priority: int = 10
    animates: bool = False
    floats: bool = False
    available: Callable[[], bool] = lambda: True


@dataclass
class Registry:
    decoders: dict[str, Decoder] = field(default_factory=dict)
    encoders: dict[str, Encoder] = field(default_factory=dict)

    def register(self, codec: Decoder | Encoder) -> None:
        """Adds a codec, or replaces the one with its id."""
        (self.decoders if isinstance(codec, Decoder) else self.encoders)[codec.id] = codec

    def unregister(self, codec_id: str) -> None:
        self.decoders.pop(codec_id, None)
        self.encoders.pop(codec_id, None)

    def decoders_for(self, fmt: str) -> list[Decoder]:
        return sorted((d for d in self.decoders.values() if d.format == fmt and _works(d)), key=lambda d: (not d.light, d.priority))

    def encoders_for(self, fmt: str) -> list[Encoder]:
        return sorted((e for e in self.encoders.values() if e.format == fmt and _works(e)), key=lambda e: e.priority)

    def readable(self) -> list[str]:
        return sorted({d.format for d in self.decoders.values() if _works(d)})

    def writable(self) -> list[str]:
        return sorted({e.format for e in self.encoders.values() if _works(e)})

    def decode(self, data: bytes, fmt: str, most_pixels: int) -> tuple[Decoded, Decoder]:
        """The first decoder's picture that succeeds; too large a picture ends the ladder, other errors move on, the last is raised."""
        ladder = self.decoders_for(fmt)
        if not ladder:
            raise UnsupportedHere(f"nothing here reads {fmt}")
        error: ImageError | None = None
        for codec in ladder:
            try:
                found = codec.decode(data)
            except TooLarge:
                raise
            except ImageError as e:
                error = e
                continue
            except Exception:  # a codec that stumbles over damaged bytes has failed to decode them
                error = DecodeFailed("the file is damaged")
                continue
            found = found if isinstance(found, Decoded) else Decoded(found)
            pixels = found.image.width * found.image.height * max(1, len(found.frames))
            if pixels > most_pixels:
                raise TooLarge(f"{pixels} pixels are more than {most_pixels}")
            if len(found.frames) == 1:
                found.frames = []
            return found, codec
        raise error or DecodeFailed()

    def encode(self, picture: Decoded, fmt: str, options: Options) -> tuple[bytes, Encoder]:
        ladder = self.encoders_for(fmt)
        if not ladder:
            raise EncodeUnsupported(f"nothing here writes {fmt}")
        error: ImageError | None = None
        for codec in ladder:
            try:
                return codec.encode(picture, options), codec
            except ImageError as e:
                error = e
            except Exception:
                error = EncodeFailed("the picture could not be written")
        raise error or EncodeFailed()


def _works(codec: Decoder | Encoder) -> bool:
    """A probe that fails means: not available."""
    try:
        return bool(codec.available())
    except Exception:
        return False


def _frames(p: Decoded) -> list[Frame]:
    return p.frames or [Frame(p.image, 0.0)]


def heif_decoder(tile_decoder: heif.TileDecoder, codec_id: str = "heic-native", path: str = "native-image", priority: int = 10) -> Decoder:
    """A reader of HEIF files: the library plans and assembles, ``tile_decoder`` gives the pixels of the coded items."""

    def decode(data: bytes) -> Decoded:
        image, gain, dropped = heif.decode(data, tile_decoder)
        return Decoded(image, exif=heif.plan(data).exif, gain_map=gain, dropped=dropped)

    return Decoder(codec_id, "heic", decode, path, priority)


def jpeg_tile(config: bytes, data: bytes, width: int, height: int) -> Raster:
    """The coded items that need no more than this library."""
    if data[:2] != b"\xff\xd8":
        raise UnsupportedHere("there is no decoder of HEVC here")
    return jpeg_pixels.decode(data).image


@dataclass(frozen=True)
class Capabilities:
    """What a registry can do."""

    readable: tuple[str, ...]
    writable: tuple[str, ...]
    animated: tuple[str, ...]
    light_in: tuple[str, ...]
    light_out: tuple[str, ...]
    native: tuple[str, ...]


def capabilities(registry: Registry) -> Capabilities:
    """Formats that can be read and written here; with several frames, as light, and by other means than the library's own code."""
    encoders, decoders = ([c for c in x.values() if _works(c)] for x in (registry.encoders, registry.decoders))
    of = lambda codecs: tuple(sorted({c.format for c in codecs}))
    return Capabilities(
        tuple(registry.readable()), tuple(registry.writable()), of(e for e in encoders if e.animates), of(d for d in decoders if d.light),
        of(e for e in encoders if e.floats), of(c for c in (*decoders, *encoders) if c.path != "pure"),
    )


def default_registry() -> Registry:
    """All codecs that need nothing but the library."""
    r = Registry()
    readers = {
        "png": png.decode, "tiff": tiff.decode, "qoi": qoi.decode, "bmp": bmp.decode, "tga": tga.decode, "pnm": pnm.decode, "farbfeld": farbfeld.decode,
        "ico": ico.decode, "psd": psd.decode, "dds": dds.decode, "hdr": hdr.decode, "exr": exr.decode, "pcx": pcx.decode, "icns": icns.decode, "ras": ras.decode,
        "xbm": xbm.decode, "xpm": xpm.decode, "jpeg": jpeg_pixels.decode,
    }
    r.register(Decoder("apng-pure", "apng", png.decode_apng, priority=20))
    r.register(Decoder("apng-fallback", "apng", png.decode, priority=30))
    r.register(Decoder("gif-pure", "gif", gif.decode, priority=20))
    r.register(Decoder("gif-fallback", "gif", lambda data: gif.decode(data, first_only=True), priority=30))
    r.register(heif_decoder(jpeg_tile, "heic-jpeg", "pure", 40))
    r.register(Decoder("raw-preview", "raw", jpeg_pixels.decode_preview, priority=20))
    r.register(Decoder("tiff-preview", "tiff", jpeg_pixels.decode_preview, priority=45))
    for fmt, read in readers.items():
        r.register(Decoder(f"{fmt}-pure", fmt, read, light=fmt in ("hdr", "exr")))
    still: dict[str, Callable[[Decoded, Options], bytes]] = {
        "png": lambda p, o: png.encode(p.image, o.palette, o.dither, o.icc, o.exif),
        "qoi": lambda p, o: qoi.encode(p.image),
        "bmp": lambda p, o: bmp.encode(p.image),
        "tga": lambda p, o: tga.encode(p.image),
        "pnm": lambda p, o: pnm.encode(p.image),
        "farbfeld": lambda p, o: farbfeld.encode(p.image),
        "tiff": lambda p, o: tiff.encode(p.image, icc=o.icc, exif=o.exif),
        "pcx": lambda p, o: pcx.encode(flatten(p.image, o.background)),
        "ras": lambda p, o: ras.encode(p.image),
        "xbm": lambda p, o: xbm.encode(p.image, o.name),
        "xpm": lambda p, o: xpm.encode(p.image, o.name),
        "ico": lambda p, o: ico.encode(p.image),
        "icns": lambda p, o: icns.encode(p.image),
        "jpeg": lambda p, o: jpeg_pixels.encode(flatten(p.image, o.background), o.quality, o.exif, o.icc),
    }
    for fmt, write in still.items():
        r.register(Encoder(f"{fmt}-pure", fmt, write))
    r.register(Encoder("hdr-pure", "hdr", lambda p, o: hdr.encode(p.image, o.background), floats=True))
    r.register(Encoder("exr-pure", "exr", lambda p, o: exr.encode(p.image), floats=True))
    r.register(Encoder("apng-pure", "apng", lambda p, o: png.encode_apng(_frames(p), p.loop_count, o.icc), animates=True))
    r.register(Encoder("gif-pure", "gif", lambda p, o: gif.encode(_frames(p), p.loop_count, o.palette or 256, o.dither, o.background), animates=True))
    return r
