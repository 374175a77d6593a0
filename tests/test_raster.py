"""Kernels in numpy, and that the relational ones agree with them."""

import numpy as np
import pytest

from pixelframe import raster as R
from pixelframe.operators import colour, geometry, palette
from pixelframe.sources.images import from_pixels, packed, to_pixels, unpacked


@pytest.fixture(scope="module")
def picture():
    data = np.random.default_rng(5).integers(0, 256, (9, 14, 4), dtype=np.uint8)
    data[2, 3, 3] = 0
    data[..., :3][data[..., 3] == 0] = 0
    return R.with_alpha(data)


@pytest.fixture(scope="module")
def pixels(spark, picture):
    rows = [(7, 14, 9, y, x, *map(int, picture.data[y, x])) for y in range(9) for x in range(14)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, y int, x int, r int, g int, b int, a int").cache()


def back(df) -> np.ndarray:
    rows = df.collect()
    out = np.zeros((max(r.height for r in rows), max(r.width for r in rows), 4), np.int64)
    for r in rows:
        out[r.y, r.x] = (r.r, r.g, r.b, r.a)
    return out


@pytest.mark.parametrize("exif", range(1, 9))
def test_orientations(picture, pixels, exif):
    from pyspark.sql import functions as F

    assert np.array_equal(back(geometry.orient(pixels, F.lit(exif))), R.orient(picture, exif).data)


@pytest.mark.parametrize("size", [(7, 5), (3, 9), (20, 11), (1, 1), (14, 4)])
def test_resize(picture, pixels, size):
    assert np.array_equal(back(geometry.resize(pixels, *size)), R.resize(picture, *size).data)


def test_square_and_crop(picture, pixels):
    assert np.array_equal(back(geometry.fit_square(pixels, 10)), R.fit_square(picture, 10).data)
    assert np.array_equal(back(geometry.crop(pixels, 2, 3, 5, 4)), R.crop(picture, 2, 3, 5, 4).data)


def test_alpha_and_colour(picture, pixels):
    assert np.array_equal(back(colour.flatten(pixels)), R.flatten(picture).data)
    assert np.array_equal(back(colour.harden_alpha(pixels)), R.harden_alpha(picture).data)
    p3 = R.Raster(picture.data, "display-p3", True)
    assert np.array_equal(back(colour.to_colour_space(pixels, "srgb")), R.to_colour_space(p3, "srgb").data)
    assert np.array_equal(back(colour.to_colour_space(pixels, "display-p3")), R.to_colour_space(picture, "display-p3").data)
    assert colour.out_of_srgb_gamut(pixels).first().outside == pytest.approx(R.out_of_srgb_gamut(p3))


def test_palettes(picture, pixels):
    few = R.Raster(picture.data & 0xC0, "srgb", True)
    found = R.exact_palette(few)
    assert np.array_equal(R.indexed_to_raster(found.indices, found.palette).data[..., 3] == 255, few.data[..., 3] >= 128)
    assert R.exact_palette(picture, 16) is None
    q = R.quantise(picture, 16)
    assert len(q.palette) <= 16 and not q.exact and q.indices.max() < len(q.palette)
    seen = palette.exact_palette(pixels, 256).count()
    exact = R.exact_palette(picture)
    assert seen == len(exact.palette)


def test_fit_longest_side():
    assert R.fit_longest_side(100, 50, 10) == (10, 5)
    assert R.fit_longest_side(100, 50, 0.5) == (100, 50)
    assert R.fit_longest_side(100, 50, 200) == (100, 50)
    assert R.fit_longest_side(1000, 1, 10) == (10, 1)


def test_rounding():
    assert R.clamped(np.array([0.5, 1.5, 2.5, -3, 300])).tolist() == [0, 2, 2, 0, 255]
    assert R.half_up(np.array([0.5, 1.5, 2.5])).tolist() == [1, 2, 3]


def test_packing(picture, pixels):
    image = from_pixels(pixels)
    assert np.array_equal(unpacked(image.first().image.asDict()).data, picture.data)
    assert np.array_equal(back(to_pixels(image)), picture.data)
    assert packed(picture)["width"] == 14
