"""Continuous ingest: new files of a folder go into the index as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine

FILE = "path string, modificationTime timestamp, length long, content binary"
#: names that the extractors take, in any case; other files are not read
NAMES = "*.{[mM][dD],[hH][tT][mM],[hH][tT][mM][lL]}"


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(source, content, checksum) of the folder's Markdown and HTML files."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", NAMES).load(folder)
    return files.select(F.col("path").alias("source"), "content", F.sha2("content", 256).alias("checksum"))


def ingest(engine: Engine, folder: str, checkpoint: str, per_trigger: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream. A batch that is run again replaces the documents it
    had written, so the index holds each file once."""
    def load(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.index_files(batch)

    stream = file_stream(engine.spark, folder, per_trigger)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
