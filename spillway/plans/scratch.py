"""A folder for queries that show what is written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows, worked out once and written: what several steps read isn't made anew by each."""
    at = folder(spark)
    rows.write.parquet(f"{at}/rows")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def places(rows: DataFrame, part: str, name: str) -> DataFrame:
    """Written rows with their place, from 1, in the order of a column of monotonically_increasing_id().

    Its upper bits tell the partition, so places are counted within each, after the sum of those before it.
    """
    of = F.shiftright(part, 33)
    n = rows.groupBy(of.alias("__of")).agg(F.count("*").alias("__n"))  # a row for each partition
    before = n.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__of").orderBy(part))
    return rows.withColumn("__of", of).join(F.broadcast(before), "__of").withColumn(name, F.col("__before") + inside).drop("__of", "__before")


def folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir, which all executors share, or local mode's own; deleted when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.gettempdir()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/spillway-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()
