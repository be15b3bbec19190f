"""Incremental ingestion: a directory of files as a stream of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.tables import scan

#: The schema of the ``binaryFile`` source.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """doc_id, path, length, content of files as they appear under ``path``."""
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def stream_table(files: DataFrame, table: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends one of the tables to Parquet; ``once`` ends when all present files are read."""
    writer = scan(files, table).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(out)
