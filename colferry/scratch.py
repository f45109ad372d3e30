"""Files of one run in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="colferry-")


class Scratch:
    """Tables and folders below spark.checkpoint.dir, which survive lost executors.

    Only where that setting is missing, as in tests, is a folder of this machine taken.
    `drop` removes a table whose readers have all finished, `keep` all tables but those named.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
        self.root = f"{base.rstrip('/')}/colferry-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self) -> None:
        """Shuffle files of finished work go now: they stay until their plans are collected as garbage, here and in the JVM.

        So does what executors' heaps have grown to: a heap is given back to the system by a full collection alone, and
        native memory and Python workers have to find room beside it. One task goes to each, while they are idle.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        others = len(self.spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1  # the driver is one, too
        if others > 0:
            self.spark.range(0, others, 1, others).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()

    def keep(self, *names: str) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(root):
            if f.getPath().getName() not in names:
                fs.delete(f.getPath(), True)
