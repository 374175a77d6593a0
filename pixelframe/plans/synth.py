"""Images made from the given tables by integer formulas, so that every query has data to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH, HEIGHT = 16, 12
#: Samples that a text is folded into: three channels of every pixel.
SAMPLES = 3 * WIDTH * HEIGHT


def folded(texts: DataFrame, samples: int) -> DataFrame:
    """``texts`` with ``samples`` numbers from 0 to 255, which every byte of the column text has a part in, in its place.

    Sample j is the sum, modulo 256, of the bytes j, j + samples, j + 2 * samples and so on, counted round and round until
    all bytes are in one. Texts must not be empty.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = sums_of(batch.column("text"), samples)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * samples)
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(sums.ravel().astype(np.int32)))], names=[*rest, "samples"])

    schema = T.StructType([*(texts.schema[c] for c in rest), T.StructField("samples", T.ArrayType(T.IntegerType()))])
    return texts.select(*rest, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def sums_of(texts, samples: int):
    """The numbers of :func:`folded` for an Arrow array of texts' bytes, a row for each text."""
    import numpy as np

    sums = np.empty((len(texts), samples), np.uint8)
    for i, raw in enumerate(texts):
        sums[i] = _sums(np.frombuffer(raw.as_buffer(), np.uint8), samples)
    return sums


def _sums(octets, samples: int):
    """The numbers of :func:`folded` for one text's bytes."""
    import numpy as np

    rest = len(octets) % samples
    sums = octets[: len(octets) - rest].reshape(-1, samples).sum(axis=0, dtype=np.uint8)
    if rest:
        sums[:rest] += octets[len(octets) - rest :]
        sums[rest:] += np.resize(octets[: samples - rest], samples - rest)  # round and round
    return sums


def text_pixels(docs: DataFrame, alpha: bool = False, few: bool = False) -> DataFrame:
    """16 x 12 pixels of every document with a text: channel k of pixel p is sample 3p + k of the whole text (see :func:`folded`).

    With ``alpha``, alpha is 255, 191, 127 or 63 by sample 7p; with ``few``, channels keep their two high bits.
    """
    size = WIDTH * HEIGHT
    texts = folded(docs.where(F.octet_length("text") > 0).select(F.col("doc_id").alias("image_id"), "text"), SAMPLES)
    # Dealt by image while an image is one short row: the pixels are made where what groups them by image needs them.
    texts = texts.repartition("image_id")
    sample = lambda at: F.element_at("samples", at + 1)
    channel = lambda p, k: sample(3 * p + k).bitwiseAND(F.lit(0xC0 if few else 0xFF))
    opaque = lambda p: 255 - sample(F.pmod(7 * p, F.lit(SAMPLES))).bitwiseAND(F.lit(0xC0)) if alpha else F.lit(255)
    pixel = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.struct(p.alias("p"), *(channel(p, k).alias(c) for k, c in enumerate("rgb")), opaque(p).alias("a")))
    p = texts.select("image_id", F.explode(pixel).alias("x"))
    return p.select("image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.floor(F.col("x.p") / WIDTH).cast("int").alias("y"), (F.col("x.p") % WIDTH).cast("int").alias("x"), *(F.col(f"x.{c}").alias(c) for c in "rgba"))


def light_pixels(embeddings: DataFrame) -> DataFrame:
    """8 x 8 pixels of light from every embedding: red is eight times the magnitude, green a half and blue a quarter of it."""
    p = embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "e"))
    v = F.abs(F.col("e").cast("double")) * 8
    return p.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).cast("int").alias("x"), v.alias("r"), (v / 2).alias("g"), (v / 4).alias("b"), F.lit(1.0).alias("a"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same pixels in DuckDB, as the tables px (opaque), pa (with alpha) and pf (few colours, with alpha), and light.
SQL = """
WITH heads AS (SELECT doc_id AS image_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
folds AS (SELECT image_id, list_transform(range(576), lambda j: list_sum(list_transform(range(0, (n + 575) // 576), lambda i: ('0x' || substr(h, 2 * ((j + 576 * i) % n) + 1, 2))::INT)) & 255) AS s FROM heads),
raw AS (SELECT image_id, p // 16 AS y, p % 16 AS x, p, s[3 * p + 1]::INT AS r0, s[3 * p + 2]::INT AS g0, s[3 * p + 3]::INT AS b0, 255 - (s[(7 * p) % 576 + 1] & 192)::INT AS a0
  FROM folds, (SELECT unnest(range(192))::INT AS p)),
px AS (SELECT image_id, 16 AS width, 12 AS height, y::INT AS y, x::INT AS x, r0 AS r, g0 AS g, b0 AS b, 255 AS a FROM raw),
pa AS (SELECT image_id, 16 AS width, 12 AS height, y::INT AS y, x::INT AS x, r0 AS r, g0 AS g, b0 AS b, a0 AS a FROM raw),
pf AS (SELECT image_id, 16 AS width, 12 AS height, y::INT AS y, x::INT AS x, r0 & 192 AS r, g0 & 192 AS g, b0 & 192 AS b, a0 AS a FROM raw),
light AS (SELECT vec_id AS image_id, 8 AS width, 8 AS height, (k // 8)::INT AS y, (k % 8)::INT AS x, v AS r, v / 2 AS g, v / 4 AS b, 1.0::DOUBLE AS a
  FROM (SELECT vec_id, unnest(range(64))::INT AS k, abs(unnest(embedding)::DOUBLE) * 8 AS v FROM embeddings))
"""


def images(docs: DataFrame, alpha: bool = False, few: bool = False) -> DataFrame:
    """(image_id, image): the pixels of :func:`text_pixels` packed, made in Arrow batches from the texts' bytes."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from ..raster import Raster
    from ..sources.images import _IMAGE, IMAGE, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.arange(WIDTH * HEIGHT)
        for batch in batches:
            made = []
            for raw in batch.column(1):
                s = _sums(np.frombuffer(raw.as_py(), np.uint8), SAMPLES)
                data = np.empty((WIDTH * HEIGHT, 4), np.uint8)
                data[:, :3] = s.reshape(-1, 3) & (0xC0 if few else 0xFF)
                data[:, 3] = 255 - (s[(7 * p) % SAMPLES] & 0xC0) if alpha else 255
                made.append(packed(Raster(data.reshape(HEIGHT, WIDTH, 4), "srgb", bool((data[:, 3] != 255).any()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, _IMAGE)], names=["image_id", "image"])

    rows = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"image_id bigint, image {IMAGE}")


def light_images(embeddings: DataFrame) -> DataFrame:
    """(image_id, image): the light of :func:`light_pixels` packed as float32."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from ..raster import Raster
    from ..sources.images import _IMAGE, IMAGE, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.column(1):
                v = np.abs(np.array(row.as_py(), np.float64)) * 8
                data = np.stack([v, v / 2, v / 4, np.ones_like(v)], axis=1).astype("<f4").reshape(8, 8, 4)
                made.append(packed(Raster(data)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, _IMAGE)], names=["image_id", "image"])

    return embeddings.select(F.col("vec_id").alias("image_id"), "embedding").mapInArrow(run, f"image_id bigint, image {IMAGE}")
