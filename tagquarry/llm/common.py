"""What the operators share: tables, written intermediate results, hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


#: Rows that Spark hands to Python at a time: whole texts are long, and several tasks share an executor's memory.
BATCH_ROWS = 1000
#: Whether Spark removes a query's shuffle files when it ends; what the last part of a path of new_path() ends in.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MADE = re.compile("-[0-9a-f]{32}$")
#: Where the session keeps the name of its folder.
FOLDER = "spark.tagquarry.folder"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def quoted(names: list[str]) -> list[str]:
    """Column names as they stand in expressions, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session's in the one that all executors share, spark.checkpoint.dir; Spark removes it when it ends.

    Where that is unset, a local session gets a folder of its own; elsewhere executors could not read each other's files.
    """
    if found := spark.conf.get(FOLDER, None):
        return found
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tagquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    found = f"{found.rstrip('/')}/tagquarry-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    spark.conf.set(FOLDER, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage and survives lost executors.

    Once it is written nothing reads its shuffles again, so Spark is told to remove their files then.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables made by saved(), once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if MADE.search(path):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than this share of all rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500


def join_by_share(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, spread: Column) -> DataFrame:
    """Left outer join of left with right, which has one row a key and, in `rows`, how many of left's rows hold it.

    Keys with over HOT_SHARE of left's `total` rows number 1 / HOT_SHARE at most: their rows of right are broadcast,
    a proven bound. All other keys are shuffled, and no task gets more of one key than that share. `spread` deals out
    the hot rows of left, which find nothing in the shuffled join. Null keys match nothing.
    """
    others = [c for c in right.columns if c not in (key, rows)]
    line = max(1000, int(total * HOT_SHARE))
    hot = right.where(F.col(rows) > line).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in others])
    cold = right.where(F.col(rows) <= line).select(F.col(key).cast("string").alias("__cold"), *others)
    dealt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(spread), F.lit(4096)).cast("string"))
    return (
        left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        .withColumn("__key", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(dealt))
        .join(cold.hint("merge"), F.col("__key") == F.col("__cold"), "left")
        .select(*quoted(left.columns), *[F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in others])
    )


def map_texts(docs: DataFrame, keep: list[str], made: Callable[[list[str | None]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """The columns `keep` of docs unchanged, and those of `schema` that `made` returns for so many rows' `text` at a time."""
    new = StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    # under plain names, as mapInArrow can't take all
    source = docs.select(*[F.col(c).alias(f"in{i}") for i, c in enumerate(quoted([*keep, "text"]))])
    whole = StructType([StructField(f"out{i}", f.dataType) for i, f in enumerate([docs.schema[c] for c in keep] + new.fields)])
    names = whole.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                got = made(part.column(len(keep)).to_pylist())
                columns = part.columns[: len(keep)] + [pa.array(got[f.name], kind) for f, kind in zip(new.fields, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()  # the worker goes on to other work

    return source.mapInArrow(run, whole).toDF(*keep, *new.names)


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(group) for the rows of equal integer keys, which fit memory; one pass over sorted partitions."""
    at = [df.columns.index(k) for k in keys]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from run(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

        for b in batches:
            if not b.num_rows:
                continue
            values = [b.column(i).to_numpy(zero_copy_only=False) for i in at]
            cut = np.zeros(b.num_rows - 1, bool)
            for v in values:
                cut |= v[1:] != v[:-1]
            edges = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
            for low, high in zip(edges, edges[1:]):
                key = tuple(v[low] for v in values)
                if key != last:
                    yield from done()
                    held, last = [], key
                held.append(b.slice(low, high - low))
        yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)
