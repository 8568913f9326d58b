"""Where runs keep logs, checkpoints and results: the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made where none is set, by application.
_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only where that is unset, as in tests, in a new local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="flowline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as written to a new path and read back, computed once, and the path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
