"""What the training-data operators share: the shared folder, staged tables and byte-level words.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Python's ``bytes.split()`` splits at
exactly these six ASCII characters, so the Arrow functions take text as bytes; SQL takes
the same class as the regular expression :data:`WORD`.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a filter that goes to all tasks.
FILTER_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset and driver and executors are one process
    (local runs, tests) a folder of our own is set. On a cluster its absence is an error: a folder of each machine's own would
    hold a part of a table only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pixelframe-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint; for narrow, small intermediate results."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths made since, for each call of :func:`finished` that is under way.
_MADE: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget_on_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes ``path`` when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    What is expensive or read several times is staged: the work is done once, and a lost
    executor costs a file read instead of a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    forget_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, staged; what was staged on the way to it is deleted at once."""
    _MADE.append([])
    try:
        out = staged(make(), name)
        *others, kept = _MADE[-1]
    finally:
        _MADE.pop()
    if _MADE:
        _MADE[-1].append(kept)
    for path in others:
        delete(out.sparkSession, path)
    return out


def _places(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8) & np.uint64(n_bits - 1)


def filter_of(hashes: DataFrame, n_bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of the one column of ``hashes`` (long): ``n_bits``, a power of two, of which each hash sets one.

    At most one row for 64 bits is collected, however many hashes there are. A filter that fills lets more through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), n_bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    found = hashes.mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through: all that it was made of, and some others."""
    at = _places(hashes, len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(name).cast("binary").alias(name)


def columns_of(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 1024) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as Python lists, in bounded slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield tuple(piece.column(piece.schema.get_field_index(n)).to_pylist() for n in names)


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that no added column can clash with them; ``name.*`` unpacks it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
