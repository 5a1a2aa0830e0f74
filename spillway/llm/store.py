"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder of our own in local mode, as in tests, and an error elsewhere."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spillway-"))
    return at.rstrip("/")


class Store:
    """Written tables of one run of an operator.  A written table outlives lost executors, and cuts lineage.

    Tables that the result still reads are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/spillway-{uuid.uuid4().hex}"
        self.marked = False

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            whole, files = self._path("")
            self.marked = files.deleteOnExit(whole)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that have ended: it does so when the driver collects garbage, which in a short job it may never do."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
