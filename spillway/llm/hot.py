"""Keys that many rows share: tables of bits before a shuffle, and first places by salted windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillway.llm.store import Store

#: Of a table of bits, whatever the number of keys: 4 MB.
BITS = 1 << 25
#: Tasks among which the rows of one hot key are spread.
SALTS = 256


def bits(keys: DataFrame, c: str) -> np.ndarray:
    """A table of BITS bits with that of each key set, as bytes; the driver gets one row for each 64 of them at most."""
    at = f"({c} & {BITS - 1}L)"
    words = keys.select(F.expr(f"{at} >> 6").alias("word"), F.expr(f"shiftleft(1L, cast({at} & 63L as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the table: all that are, and of others as large a share as the table has bits set."""
    at = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def places(store: Store, rows: DataFrame) -> DataFrame:
    """doc_id, later, place of the rows (h, doc_id, place, hot) whose h has another row; the first by (doc_id, place) isn't later.

    hot depends on h alone.  The rows of a hot h are counted and ordered in SALTS parts, of
    which only the first rows are brought together.
    """
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    part = Window.partitionBy("h", "salt")
    rows = rows.withColumn("salt", salt).select("h", "salt", "doc_id", "place", "hot", F.count(F.lit(1)).over(part).alias("n"), F.row_number().over(part.orderBy("doc_id", "place")).alias("k")).where("n > 1 OR hot")
    rows = store.table(rows.select("doc_id", "place", (F.col("k") > 1).alias("later"), F.when(F.col("hot"), F.col("h")).alias("h"), F.when(F.col("hot") & (F.col("k") == 1), F.col("n")).alias("n")), "places")
    firsts = rows.where("n IS NOT NULL").groupBy("h").agg(F.sum("n").alias("all"), F.min(F.struct("doc_id", "place")).alias("first")).where(F.col("all") > 1)
    firsts = store.table(firsts, "firsts")
    hot = rows.where("h IS NOT NULL").join(firsts, "h").select("doc_id", (F.col("later") | (F.struct("doc_id", "place") != F.col("first"))).alias("later"), "place")
    return rows.where("h IS NULL").select("doc_id", "later", "place").unionByName(hot)
