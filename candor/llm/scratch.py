"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder; only where a local session leaves it unset (as in unit
tests) a fresh temporary folder is made and set. A written table cuts lineage and survives the
loss of executors, and reading it back restores column pruning and size statistics.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, qualified by the file system that Spark resolves it against.

    On a cluster it has to be set: a folder of the driver's own machine would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="candor-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Scratch:
    """Named tables of one operator run, under one unique folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written table."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._candor_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._candor_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
