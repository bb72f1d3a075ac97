"""Shared scratch tables of operators that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Written tables in the folder that the cluster names in spark.checkpoint.dir.

    They cut lineage and survive lost executors. Only where that setting is absent, as in local
    tests, /tmp/checkpoints is used; a cluster without it is an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file:///tmp/checkpoints"
        self.root = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
