"""Written intermediate tables in the folder that all executors share.

They lie under one folder for each application, which goes when Python ends; tables
that no later plan reads are discarded before.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_seen: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs in this machine's one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="graftline-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    top = f"{shared_dir(spark)}/graftline/{spark.sparkContext.applicationId}"
    if top not in _seen:
        _seen.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in stashed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
