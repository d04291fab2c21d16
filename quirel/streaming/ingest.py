"""Continuous ingestion: new files become object tables, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirel.sources.objects import read_objects


def stream_pdf(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (doc_id, path, length, content) of the files that appear below path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def ingest(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Writes the objects of a stream's files as Parquet, a folder per batch: a batch that is run again replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        found = read_objects(batch).select("doc_id", "obj_num", F.to_json("value").alias("json"), "data", "error", "gen")
        found.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
