"""Streams: continuous scans, debounce, circuit breaker, seen sets (STR-01 to STR-09)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spillway.operators import scan
from spillway.schema import ITEM

FAILURES, OPEN_S = 3, 30.0


def item_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Items from JSON files as they come, so many at a time (backpressure)."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def scan_stream(items: DataFrame, **rules) -> DataFrame:
    """Findings of a stream of items; stateless, as the batch scan is one narrow pass."""
    return scan.findings(items, **rules)


def once(stream: DataFrame, *keys: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen before; with a time column the state is let go after `late`."""
    if time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def debounced(edits: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """uri, text: the last text of each burst of edits, after `quiet` without another.  edits: uri, ts, version, text.

    A batch and a stream give the same; a stream gives a burst when its window has closed.
    """
    if edits.isStreaming:
        edits = edits.withWatermark("ts", late)
    burst = edits.groupBy("uri", F.session_window("ts", quiet).alias("w"))
    return burst.agg(F.max_by("text", F.struct("ts", "version")).alias("text"), F.count("*").alias("edits")).select("uri", F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "text", "edits")


def breaker(calls: DataFrame, failures: int = FAILURES, open_seconds: float = OPEN_S) -> DataFrame:
    """host, ts, ok, allowed of a batch of calls: after so many failures in a row a host is closed for a time.

    A refused call changes nothing; a success opens the host.  The state is a number and a
    time for each host, folded in order of time.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "call_id"])
        allowed, n, until = [], 0, -float("inf")
        for t, ok in zip(pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["ok"]):
            go = t >= until
            allowed.append(go)
            if go:
                n = 0 if ok else n + 1
                if n >= failures:
                    until = t + open_seconds
        return pdf.assign(allowed=allowed)

    return calls.select("host", "call_id", "ts", "ok").groupBy("host").applyInPandas(fold, "host string, call_id long, ts timestamp, ok boolean, allowed boolean")


def breaker_stream(calls: DataFrame, failures: int = FAILURES, open_seconds: float = OPEN_S) -> DataFrame:
    """The same for a stream, with the state kept between its batches."""
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, until = state.get if state.exists else (0, -1e18)
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "call_id"])
            allowed = []
            for t, ok in zip(pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["ok"]):
                go = t >= until
                allowed.append(go)
                if go:
                    n = 0 if ok else n + 1
                    if n >= failures:
                        until = t + open_seconds
            yield pdf.assign(allowed=allowed)[["host", "call_id", "ts", "ok", "allowed"]]
        state.update((n, until))

    out = "host string, call_id long, ts timestamp, ok boolean, allowed boolean"
    return calls.select("host", "call_id", "ts", "ok").groupBy("host").applyInPandasWithState(fold, out, "n int, until double", "append", GroupStateTimeout.NoTimeout)


def error_streaks(events: DataFrame, failures: int = FAILURES) -> DataFrame:
    """user_id, first, last, n of runs of errors in a user's events: gaps and islands, without a fold."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    rows = events.select("user_id", "ts", "event_id", bad.alias("bad"), (F.row_number().over(w) - F.sum(bad.cast("int")).over(w)).alias("island"))
    return rows.where("bad").groupBy("user_id", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).where(F.col("n") >= failures).drop("island")


def start_scan(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True, **rules):
    """A query that scans the files of a folder into a table of findings."""
    writer = scan_stream(item_stream(spark, folder), **rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
