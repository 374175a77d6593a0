"""The formats that are known, as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Format:
    id: str
    label: str
    mimes: tuple[str, ...]
    extensions: tuple[str, ...]
    alpha: bool
    lossy: bool
    animated: bool

    @property
    def mime(self) -> str:
        return self.mimes[0]

    @property
    def extension(self) -> str:
        return self.preferred or self.extensions[0]

    preferred: str = ""


def _row(name: str, label: str, mimes: str, extensions: str, traits: str, preferred: str = "") -> Format:
    """``traits`` has a for alpha, l for lossy, m for moving."""
    return Format(name, label, tuple(mimes.split()), tuple(extensions.split()), "a" in traits, "l" in traits, "m" in traits, preferred)


#: Identifier, label, media types (the first is written), extensions, traits.
FORMATS: tuple[Format, ...] = (
    _row("heic", "HEIC", "image/heic image/heif image/heic-sequence image/heif-sequence", "heic heif hif", "al"),
    _row("png", "PNG", "image/png", "png", "a"),
    _row("apng", "APNG", "image/apng", "apng", "am"),
    _row("jpeg", "JPEG", "image/jpeg image/jpg image/pjpeg", "jpg jpeg jpe jfif", "l"),
    _row("jxl", "JPEG XL", "image/jxl", "jxl", "alm"),
    _row("webp", "WebP", "image/webp", "webp", "alm"),
    _row("avif", "AVIF", "image/avif image/avif-sequence", "avif avifs", "alm"),
    _row("gif", "GIF", "image/gif", "gif", "am"),
    _row("bmp", "BMP", "image/bmp image/x-ms-bmp image/x-bmp", "bmp dib", "a"),
    _row("ico", "ICO", "image/x-icon image/vnd.microsoft.icon", "ico cur", "a"),
    _row("tiff", "TIFF", "image/tiff image/tif", "tif tiff", "a"),
    _row("raw", "Camera raw", "image/x-dcraw image/x-canon-cr2 image/x-nikon-nef image/x-sony-arw", "dng cr2 cr3 nef nrw arw srf sr2 raf orf rw2 pef srw raw 3fr iiq erf mos dcr kdc", "l"),
    _row("psd", "Photoshop", "image/vnd.adobe.photoshop application/x-photoshop image/psd", "psd psb", "a"),
    _row("dds", "DDS", "image/vnd-ms.dds image/x-dds", "dds", "al"),
    _row("hdr", "Radiance HDR", "image/vnd.radiance image/x-hdr", "hdr pic rgbe", ""),
    _row("exr", "OpenEXR", "image/x-exr image/aces", "exr", "a"),
    _row("pcx", "PCX", "image/x-pcx image/vnd.zbrush.pcx", "pcx pcc", ""),
    _row("icns", "Apple icon", "image/icns image/x-icns", "icns", "a"),
    _row("ras", "Sun raster", "image/x-cmu-raster image/x-sun-raster", "ras sun im1 im8 im24 im32", "a"),
    _row("xbm", "XBM", "image/x-xbitmap image/x-xbm", "xbm", "a"),
    _row("xpm", "XPM", "image/x-xpixmap image/x-xpm", "xpm", "a"),
    _row("qoi", "QOI", "image/qoi image/x-qoi", "qoi", "a"),
    _row("tga", "TGA", "image/x-tga image/x-targa image/tga", "tga icb vda vst", "a"),
    _row("pnm", "PNM", "image/x-portable-anymap image/x-portable-pixmap image/x-portable-graymap image/x-portable-bitmap image/x-portable-arbitrarymap", "pnm ppm pgm pbm pam", "a", "ppm"),
    _row("farbfeld", "farbfeld", "image/x-farbfeld", "ff", "a"),
    _row("svg", "SVG", "image/svg+xml", "svg", "a"),
)
BY_ID = {f.id: f for f in FORMATS}
#: Formats that a browser shows; formats that can state a wide gamut.
DISPLAYABLE = ("png", "apng", "jpeg", "webp", "avif", "gif", "bmp", "ico", "svg")
WIDE_GAMUT = ("png", "apng", "jpeg", "webp", "avif", "tiff", "hdr", "exr")


def format_for_mime(mime: str) -> str | None:
    wanted = mime.lower().split(";")[0].strip()
    return next((f.id for f in FORMATS if wanted in f.mimes), None) if wanted else None


def format_for_extension(name: str) -> str | None:
    _, dot, extension = name.rpartition(".")
    return next((f.id for f in FORMATS if extension.lower() in f.extensions), None) if dot else None


def formats_table(spark: SparkSession) -> DataFrame:
    """One row for each format."""
    rows = [(f.id, f.label, f.mime, list(f.mimes), f.extension, list(f.extensions), f.alpha, f.lossy, f.animated, f.id in DISPLAYABLE) for f in FORMATS]
    return spark.createDataFrame(rows, "id string, label string, mime string, mimes array<string>, extension string, extensions array<string>, alpha boolean, lossy boolean, animated boolean, displayable boolean")
