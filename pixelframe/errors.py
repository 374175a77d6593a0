"""Errors with stable codes. In permissive plans they become columns; they never name a file."""

from __future__ import annotations


class ImageError(Exception):
    code = "decode/failed"

    def __init__(self, message: str = ""):
        super().__init__(message or self.code)


class EmptyInput(ImageError):
    code = "input/empty"


class UnknownFormat(ImageError):
    code = "input/unknown-format"


class TooLarge(ImageError):
    code = "input/too-large"


class UnsupportedHere(ImageError):
    code = "decode/unsupported-here"


class DecodeFailed(ImageError):
    code = "decode/failed"


class SurfaceTooLarge(ImageError):
    code = "codec/surface-too-large"


class EncodeUnsupported(ImageError):
    code = "encode/unsupported"


class EncodeFailed(ImageError):
    code = "encode/failed"


class HeifMalformed(ImageError):
    code = "heif/malformed"


class HeifUnsupported(ImageError):
    code = "heif/unsupported-feature"


class CodecUnavailable(ImageError):
    code = "codec/unavailable"


class Cancelled(ImageError):
    code = "cancelled"


CODES = tuple(c.code for c in (EmptyInput, UnknownFormat, TooLarge, UnsupportedHere, DecodeFailed, SurfaceTooLarge, EncodeUnsupported, EncodeFailed, HeifMalformed, HeifUnsupported, CodecUnavailable, Cancelled))
