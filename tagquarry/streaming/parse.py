"""Parsing of streams: each micro-batch goes through the same stateless operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.relation import Options, events, nodes


def pages(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def parsed(stream: DataFrame, key: str, column: str = "html", options: Options = Options(), tokens: bool = False) -> DataFrame:
    """nodes, or events, of a stream of documents: no state and no watermark."""
    return (events if tokens else nodes)(stream, key, column, options)


def written(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
