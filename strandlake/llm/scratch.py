"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

Iterative operators cut their lineage here: a written table survives the loss of any
executor, and a later stage reads it instead of computing it again.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_FILES = 200_000


def _plain_files(df: DataFrame) -> bool:
    """Whether df is one Parquet relation, at most filtered or with columns chosen, so that a row's file and place name it."""
    if "_metadata" in df.columns:
        return False
    plan = df._jdf.queryExecution().analyzed().toString().strip().splitlines()
    nodes = [re.match(r"[\s:+-]*'?(\w+)", line)[1] for line in plan]
    return nodes[-1] == "Relation" and plan[-1].rstrip().endswith(" parquet") and all(n in ("Project", "Filter") for n in nodes[:-1])


def root(spark: SparkSession) -> str:
    """The shared folder; a folder of our own only where none is set and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def purge(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application's finished calls; results that were not yet written need theirs."""
    _delete(spark, f"{root(spark)}/strandlake/{spark.sparkContext.applicationId}")


class Scratch:
    """Tables of one operator call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{root(spark)}/strandlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[DataFrame, str] = {}

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a reader of what was written."""
        at = self.folder(name)
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._at[out] = at
        return out

    def numbered(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df with a number of each row that stays the same whenever it is read, and the name of that column, which df does not have.

        Rows that are read from Parquet files as they are have one by nature: their place in their file and a number of that, of which
        there is a row each in a broadcast (_FILES at most). Other tables are written with a number.
        """
        name = "__row"
        while name in df.columns:
            name += "_"
        if _plain_files(df):
            tagged = df.select("*", F.col("_metadata.file_path").alias(name + "f"), F.col("_metadata.row_index").alias(name + "i"))
            files = self.table(tagged.select(F.col(name + "f").alias("f")).distinct(), "files")
            if files.count() <= _FILES:
                files = self.table(files.withColumn("n", F.row_number().over(Window.orderBy("f"))), "file-numbers")
                out = tagged.join(F.broadcast(files), F.col(name + "f") == F.col("f"))
                return out.select(*(F.col(f"`{c}`") for c in df.columns), F.expr(f"shiftleft(cast(n as bigint), 40) | `{name}i`").alias(name)), name
        return self.table(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this call that nothing will read again."""
        _delete(self.spark, self._at.pop(df))

    def sweep(self) -> None:
        """Let Spark's cleaner remove shuffle files of jobs that are over; it works on what two collections have found."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)
