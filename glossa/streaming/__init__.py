"""Structured Streaming over the same plans: extraction is stateless across documents, so a stream runs the batch plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.lineage import folder as shared_folder
from glossa.plans.rules import extract


def read_stream(spark: SparkSession, folder: str, file: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of a Parquet table of a folder, whether it is a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    # a stream takes a single file by a pattern only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{folder}/{{{file}}}")


def finished(stream: DataFrame) -> DataFrame:
    """What an aggregating stream has found when it has read all there is: a table in the shared folder, as are the stream's own state and offsets."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/result")  # a stream without files has no batch

    def keep(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{out}/result")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/result")


def extract_stream(documents: DataFrame, grammar: str, keys: list[str]) -> DataFrame:
    """Mentions of a stream of documents with sentences, by the same pass as in batch."""
    return extract(documents, grammar, keys)


def windowed_counts(events: DataFrame, time: str, late: str, length: str, *keys: str) -> DataFrame:
    """Counts in windows of event time; state is dropped once the watermark passes a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")
