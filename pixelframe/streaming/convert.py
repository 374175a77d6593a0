"""Files that keep arriving, converted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.convert import Settings, convert
from ..registry import Registry

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """New files of ``folder``, each once."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def convert_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, settings: Settings | None = None, registry: Registry | None = None) -> StreamingQuery:
    """Converts what arrives and appends it, report and all, to the Parquet table ``output``; what is there is done once."""
    made = convert(read_stream(spark, folder), settings, registry)
    return made.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
