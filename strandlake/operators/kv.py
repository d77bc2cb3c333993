"""A store of JSON values by key, as a table of (id, data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.scalars import pack_json, unpack_json


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


class Store:
    """Versions of (id, data) under a path; every put appends a part with its own number, reads see the newest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, version: int) -> None:
        """rows: (id, json). Putting the same version again replaces it."""
        packed = rows.select("id", pack_json(F.col("json")).alias("data"))
        packed.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def items(self) -> DataFrame:
        """(id, json) of the newest versions."""
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/version=*")
        return latest(rows, "id", "version").select("id", unpack_json(F.col("data")).alias("json"))

    def get(self, ids: DataFrame, default: str | None = None) -> DataFrame:
        """(id, json) for the ids asked for; the default where there is none or the stored value is null."""
        found = self.items().where("json <> 'null'")
        return ids.select("id").join(found, "id", "left").select("id", F.coalesce("json", F.lit(default)).alias("json"))

    def contains(self, ids: DataFrame) -> DataFrame:
        """(id, known): whether there is a value for each id; a stored null counts as none."""
        found = self.items().where("json <> 'null'").select("id", F.lit(True).alias("known"))
        return ids.select("id").join(found, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))

    def keys(self) -> DataFrame:
        return self.items().select("id")
