"""Images as rows: files in, packed images and pixels, files out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImageError
from ..functions import detect
from ..functions.naming import output_name
from ..raster import Decoded, Raster, with_alpha
from ..registry import Options, Registry, default_registry

IMAGE = "struct<width:int,height:int,colour_space:string,has_alpha:boolean,data:binary>"
_IMAGE = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("colour_space", pa.string()), ("has_alpha", pa.bool_()), ("data", pa.binary())])


#: Pixel rows and payload bytes that are sent on at once.
ROWS, HELD = 65_536, 16 << 20


def in_pieces(batch: pa.RecordBatch, make, schema, size) -> Iterator[pa.RecordBatch]:
    """``make(i)`` for every row of ``batch`` behind its first column, in record batches of about HELD bytes."""
    held, first, total = [], 0, 0
    for i in range(batch.num_rows):
        held.append(make(i))
        total += size(held[-1])
        if total >= HELD or i + 1 == batch.num_rows:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), *columns], names=["key", *(n for n, _ in schema)])
            held, first, total = [], i + 1, 0


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files in a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def with_format(files: DataFrame) -> DataFrame:
    """Adds ``format`` by the content's signature."""
    return files.withColumn("format", detect.format_of(F.col("content")))


def packed(image: Raster) -> dict:
    return {"width": image.width, "height": image.height, "colour_space": image.colour_space, "has_alpha": image.has_alpha, "data": np.ascontiguousarray(image.data).tobytes()}


def unpacked(row: dict) -> Raster:
    data, shape = row["data"], (row["height"], row["width"], 4)
    kind = np.uint8 if len(data) == shape[0] * shape[1] * 4 else np.dtype("<f4")
    return Raster(np.frombuffer(data, kind).reshape(shape), row["colour_space"], row["has_alpha"])


def decode(files: DataFrame, key: str = "path", content: str = "content", most_pixels: int = 80_000_000, registry: Registry | None = None) -> DataFrame:
    """key, format, image, n_frames, loop_count and error_code of each file."""
    registry = registry or default_registry()

    def one(data: bytes | None) -> tuple:
        fmt = None
        try:
            fmt = detect.required(data or b"")
            found, _ = registry.decode(data, fmt, most_pixels)
            return fmt, packed(found.image), max(1, len(found.frames)), found.loop_count, None
        except ImageError as e:
            return fmt, None, 0, 0, e.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = (("format", pa.string()), ("image", _IMAGE), ("n_frames", pa.int32()), ("loop_count", pa.int32()), ("error_code", pa.string()))
        for batch in batches:
            yield from in_pieces(batch, lambda i, batch=batch: one(batch.column(1)[i].as_py()), schema, lambda r: len(r[1]["data"]) if r[1] else 0)

    kind = files.schema[key].dataType.simpleString()
    out = files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(run, f"key {kind}, format string, image {IMAGE}, n_frames int, loop_count int, error_code string")
    return out.withColumnRenamed("key", key)


def encode(images: DataFrame, to: str, key: str = "image_id", options: Options | None = None, registry: Registry | None = None) -> DataFrame:
    """key, content and error_code: each ``image`` written in format ``to``."""
    options, registry = options or Options(), registry or default_registry()

    def one(image: dict) -> tuple[bytes | None, str | None]:
        try:
            return registry.encode(Decoded(unpacked(image)), to, options)[0], None
        except ImageError as e:
            return None, e.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_pieces(batch, lambda i, batch=batch: one(batch.column(1)[i].as_py()), (("content", pa.binary()), ("error_code", pa.string())), lambda r: len(r[0] or b""))

    kind = images.schema[key].dataType.simpleString()
    return images.select(F.col(key).alias("key"), "image").mapInArrow(run, f"key {kind}, content binary, error_code string").withColumnRenamed("key", key)


def to_pixels(images: DataFrame, key: str = "image_id") -> DataFrame:
    """The pixels relation of packed byte images, unpacked in Arrow columns."""

    def rows(ids: list, kind: pa.DataType, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        owners = np.repeat(np.arange(len(ids)), [len(h[0]) for h in held])
        names = pa.array(ids, kind)
        for at in range(0, len(owners), ROWS):
            part = slice(at, at + ROWS)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owners[part])), *(pa.array(c[part]) for c in columns)], names=["image_id", "width", "height", "y", "x", "r", "g", "b", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for i in range(batch.num_rows):
                image = unpacked(batch.column(1)[i].as_py())
                n = image.width * image.height
                y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(image.width))
                flat = image.data.reshape(-1, 4).astype(np.int32)
                held.append((np.full(n, image.width, np.int32), np.full(n, image.height, np.int32), y, x, *(flat[:, c] for c in range(4))))
                ids.append(batch.column(0)[i].as_py())
                size += n
                if size >= ROWS:
                    yield from rows(ids, batch.schema.field(0).type, held)
                    ids, held, size = [], [], 0
            yield from rows(ids, batch.schema.field(0).type, held)

    kind = images.schema[key].dataType.simpleString()
    return images.where(F.col("image").isNotNull()).select(F.col(key), "image").mapInArrow(run, f"image_id {kind}, width int, height int, y int, x int, r int, g int, b int, a int")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, image): the pixels of each image packed; one image is one group."""
    kind = pixels.schema["image_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        width, height = table.column("width")[0].as_py(), table.column("height")[0].as_py()
        at = table.column("y").to_numpy().astype(np.int64) * width + table.column("x").to_numpy()
        data = np.zeros((height * width, 4), np.uint8)
        for c, name in enumerate("rgba"):
            data[at, c] = table.column(name).to_numpy()
        image = packed(with_alpha(data.reshape(height, width, 4)))
        return pa.Table.from_arrays([table.column("image_id").slice(0, 1), pa.array([image], _IMAGE)], names=["image_id", "image"])

    return pixels.select("image_id", "width", "height", "y", "x", "r", "g", "b", "a").groupBy("image_id").applyInArrow(run, f"image_id {kind}, image {IMAGE}")


def named_outputs(converted: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``output_name`` from the file's name and the new extension."""
    return converted.withColumn("output_name", output_name(F.element_at(F.split(F.col(path), "/"), -1), F.col("extension")))


def write_files(converted: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Writes every converted file under ``folder``, which all executors share; returns name and bytes of each.

    A file is written under another name and renamed, so a second attempt of a task leaves one whole file.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = folder.startswith(("/", "file:"))
        files, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                draft = f"{root}/_{name}-{attempt}"
                with files.open_output_stream(draft) as out:
                    out.write(content.as_py())
                files.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_py()) for c in batch.column(1)], pa.int64())], names=["output_name", "n_bytes"])

    return named_outputs(converted.where("ok"), path).select("output_name", "content").mapInArrow(run, "output_name string, n_bytes bigint")


def largest_error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (image_id, a, b), packed light of one size: the largest difference of a sample, in parts of its pixel's largest (of 0.0001 at least)."""
    for batch in batches:
        found = []
        for a, b in zip(batch.column(1), batch.column(2), strict=True):
            a, b = (np.frombuffer(x.as_py(), "<f4").reshape(-1, 4)[:, :3].astype(np.float64) for x in (a, b))
            found.append(float((np.abs(a - b) / np.maximum(a.max(axis=1, keepdims=True), 1e-4)).max()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["image_id", "error"])
