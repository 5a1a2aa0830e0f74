"""Sharding: contiguous shards of equal bytes, from global prefix sums.

Order is doc_id, then size.  Each range partition's total is summed, the totals (one row a
partition) give each partition its first byte, and a running sum inside the partition gives
each document its own.  A document belongs to the shard in which it starts, so shards differ
from the target by less than their last document.

Defined cases: a null text has 0 bytes; null doc_ids come first; repeated rows each take
their own bytes; an empty table gives no rows; if all texts are empty there is one shard, 0.
Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.store import Store, partitions

N_SHARDS = 64

SQL = f"""
WITH s AS (SELECT doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS n_bytes FROM {{docs}}),
r AS (SELECT *, CAST(SUM(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_bytes AS start_byte,
  CAST(SUM(n_bytes) OVER () AS BIGINT) AS total FROM s)
SELECT doc_id, n_bytes, start_byte,
  CAST(start_byte // GREATEST(1, (total + {N_SHARDS - 1}) // {N_SHARDS}) AS BIGINT) AS shard FROM r
"""


def shard(spark: SparkSession, docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, n_bytes, start_byte, shard for every row of docs."""
    store = Store(spark)
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    sizes = store.table(sizes, "sizes")  # range partitioning samples its input: the text is read once only
    ranged = sizes.repartitionByRange(partitions(spark), "doc_id", "n_bytes").withColumn("part", F.spark_partition_id())
    # Ranges come from a sample, so they must be written before totals and running sums both rely on them.
    ranged = store.table(ranged, "ranged")
    store.drop("sizes")
    totals = ranged.groupBy("part").agg(F.sum("n_bytes").alias("part_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("part_start"),
        F.sum("part_bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    running = F.sum("n_bytes").over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "n_bytes").rowsBetween(Window.unboundedPreceding, 0))
    step = F.greatest(F.lit(1), F.expr(f"(total + {n_shards - 1}) div {n_shards}"))
    return (
        ranged.withColumn("inside", running - F.col("n_bytes"))
        .join(totals, "part")
        .select("doc_id", "n_bytes", (F.col("part_start") + F.col("inside")).alias("start_byte"), step.alias("step"))
        .select("doc_id", "n_bytes", "start_byte", F.expr("start_byte div step").alias("shard"))
    )
