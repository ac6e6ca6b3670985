"""Uploads as a stream: line files that land in a folder are appended to the table, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uploads(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Streaming lines of the CSV files that land in folder, with the file's stem as trial where it names none."""
    stem = F.regexp_extract(F.input_file_name(), "([^/]+)\\.[^./]+$", 1)
    lines = spark.readStream.schema(schema).option("header", True).csv(folder)
    return lines.withColumn("TRIAL", F.coalesce(F.nullif(F.trim("TRIAL"), F.lit("")), stem))


def append(lines: DataFrame, table_dir: str, checkpoint: str, once: bool = True):
    """Start appending to a Parquet table; the checkpoint makes a restarted run resume."""
    writer = lines.writeStream.format("parquet").option("path", table_dir).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
