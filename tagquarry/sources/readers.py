"""HTML from storage, and results to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of files of bytes."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def table(spark: SparkSession, path: str, key: str, column: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(path).select(key, column)


def spread(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs over more tasks before a parse, where a source gives few partitions."""
    return docs.repartition(partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def joined(results: DataFrame, key: str, order: str, column: str, markdown: bool = False) -> DataFrame:
    """(key, text): a document's results in order, a line each (Markdown: a blank line between), with a final line break."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, column))), lambda x: x[column])
    return results.groupBy(key).agg(F.concat(F.array_join(listed, "\n\n" if markdown else "\n"), F.lit("\n")).alias("text"))


def write_text(results: DataFrame, path: str) -> None:
    results.select("text").write.text(path)
