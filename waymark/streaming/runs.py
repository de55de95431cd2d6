"""Streams over files: sources, event-time sessions, and runs to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.durable import shared_folder


def parquet_source(spark: SparkSession, path: str, files_each: int = 8) -> DataFrame:
    """Parquet files as a stream, so many of them in a micro-batch; the schema is the files' own."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def session_gaps(rows: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """key, start, end, samples of a key's runs without such a gap, on event time.

    A run closes when the watermark passes its end; rows later than that are
    dropped by the stream, as after a device's timeline was reset.  In a table all rows count.
    """
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    runs = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.max(at).alias("end"), F.count("*").alias("samples"))
    return runs.select(key, F.col("w.start").alias("start"), "end", "samples")


def finish(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream over all that its source holds now, as a table in the folder of spark.checkpoint.dir.

    Offsets and state are kept there too, so a run that loses its executors goes on.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start(at)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
