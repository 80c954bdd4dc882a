"""Tables that outlive the plan that made them, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: (application, name) to the path of a table written by stored().
_PATHS: dict[tuple[str, str], str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the session ends. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(spark: SparkSession, name: str, make) -> DataFrame:
    """The table `name`, written as Parquet when it is first asked for in this application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _PATHS:
        path = shared_path(spark, "tagquarry-" + re.sub("[^a-z0-9]+", "-", name.lower()).strip("-"))
        make().write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])
