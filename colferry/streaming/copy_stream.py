"""COPY over Structured Streaming: each micro-batch of a stream becomes one Parquet file of its own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from colferry.operators.copy_to import copy_to
from colferry.types import Relation, spark_type
from pyspark.sql import types as T


def read_stream(spark: SparkSession, relation: Relation, folder: str, max_files: int = 1000) -> DataFrame:
    """New Parquet files below a folder, read by the relation's declared types."""
    schema = T.StructType([T.StructField(c.name, spark_type(c.type)) for c in relation.columns])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(folder)


def copy_stream_to(stream: DataFrame, folder: str, checkpoint: str, options: Mapping[str, object] | None = None, once: bool = False) -> StreamingQuery:
    """Files named by the batch's number, so that a batch that runs again replaces its own file.

    With file_size_bytes among the options, a batch is a folder of that name, which all tasks write at once.
    """

    def put(batch: DataFrame, number: int) -> None:
        copy_to(batch, f"{folder.rstrip('/')}/batch_{number:08d}.parquet", options)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
