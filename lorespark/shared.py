"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and driver and executors
    are one process (tests) is it a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="lorespark-")
        base = _own_dirs[context.applicationId]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{shared_dir(spark)}/lorespark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def drop(*stored: DataFrame) -> None:
    """Delete tables of :func:`store` that nothing reads any more."""
    for df in stored:
        delete(df.sparkSession, _stored.pop(df))


def clear(spark: SparkSession) -> None:
    """Delete all that operators have stored for this application; results that were not written elsewhere can no longer be read."""
    delete(spark, new_path(spark, "").rpartition("/")[0])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
