"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

A written table survives the loss of any executor and cuts the lineage: what reads it computes nothing again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder; a folder of our own only where none is set and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return "file://" + _OWN[sc.applicationId]


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own that nothing has been written to."""
    return f"{root(spark)}/strandlake-work/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a reader of what was written."""
    at = folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def purge(spark: SparkSession) -> None:
    """Delete the tables of this application; DataFrames that still read them fail afterwards."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/strandlake-work/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
