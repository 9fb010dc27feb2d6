"""The shared folder of the session, for tables that a job writes on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names. Only where that is unset and the master is local, a temporary one that ends with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            held = tempfile.TemporaryDirectory(prefix="tallystone-")
            atexit.register(held.cleanup)
            _own[app] = held.name
        base = f"file://{_own[app]}"
    return f"{base.rstrip('/')}/tallystone/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to a new folder and read from there, for what is read more than once."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
