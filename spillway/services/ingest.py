"""Requests to scan texts, one by one or in batches, as tables and streams (SRC-24, AGG-11, STR-03, STR-07, FLT-27, SNK-08).

A request is a row of request_id, arrived, path, source and text.  What a server would hold
in memory is the plan's business here: admission is a limit a batch, counters are observed
metrics, and a request's answer is its findings and what became of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from spillway.operators import scan

REQUEST = "request_id long, arrived timestamp, path string, source string, text string"
MOST_BYTES, MOST_REQUESTS, MOST_FINDINGS, RETRY_S = 10 << 20, 1000, 5000, 1


def admitted(requests: DataFrame, most: int = MOST_REQUESTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """requests with `status`: 200 for the first `most` to arrive, 413 for a text that is too large, 503 for the others, which may come again.

    The limit is a batch's, as a stream's trigger bounds it (maxFilesPerTrigger); a rank over
    ids and times alone orders it, so no text is moved.
    """
    large = F.coalesce(F.octet_length("text") > most_bytes, F.lit(False))
    rows = requests.withColumn("__large", large)
    rank = F.row_number().over(Window.orderBy("arrived", "request_id"))
    first = rows.where("NOT __large").select("request_id", "arrived").withColumn("__k", rank).where(F.col("__k") <= most).select(F.col("request_id").alias("__in"))
    rows = rows.join(first, F.col("request_id") == F.col("__in"), "left")
    status = F.when(F.col("__large"), 413).when(F.col("__in").isNotNull(), 200).otherwise(503)
    return rows.withColumn("status", status).drop("__large", "__in")


def answers(requests: DataFrame, most_findings: int = MOST_FINDINGS, **rules) -> DataFrame:
    """request_id, status, retry_after, findings (worst first) and truncated of each request of admitted().

    A text whose scan fails has status 500, and takes no other with it.
    """
    items = requests.select(F.col("request_id").alias("item_id"), F.when(F.col("status") == 200, F.col("text")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("path", F.lit("")).alias("path"), F.lit(None).cast("map<string,string>").alias("meta"), "status")
    hits = F.coalesce(scan.found(F.col("text"), F.col("path"), F.col("source"), **rules), F.array())
    rows = items.withColumn("f", hits)
    order = lambda a, b: F.coalesce(*(F.when(x < y, s).when(x > y, -s) for x, y, s in ((_rank(a), _rank(b), 1), (a["line"], b["line"], -1), (a["col"], b["col"], -1), (a["type"], b["type"], -1))), F.lit(0))
    real = F.filter("f", lambda x: ~x["type"].isin(scan.FAILED, "results_truncated"))
    shown = F.transform(F.slice(F.array_sort(real, order), 1, most_findings), lambda x: F.struct(x["type"].alias("type"), x["severity"].alias("severity"), x["line"].alias("line"), x["col"].alias("col"), scan.T.redact(x["value"]).alias("redacted"), scan.T.fingerprint(x["type"], F.col("path"), x["value"]).alias("fingerprint")))
    failed = F.exists("f", lambda x: x["type"] == scan.FAILED)
    cut = F.exists("f", lambda x: x["type"] == "results_truncated") | (F.size(real) > most_findings)
    return rows.select(F.col("item_id").alias("request_id"), F.when(failed, 500).otherwise(F.col("status")).alias("status"), F.when(F.col("status") == 503, F.lit(RETRY_S)).alias("retry_after"), shown.alias("findings"), cut.alias("truncated"))


def _rank(x):
    return scan.T.sev_rank(x["severity"])


def _counts() -> dict:
    return {
        "scanned": F.count_if(F.col("status") == 200), "findings": F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long"), "errors": F.count_if(F.col("status") == 500), "rejected": F.count_if(F.col("status").isin(413, 503)), "truncated": F.count_if("truncated"),
    }


def counters(answered: DataFrame) -> DataFrame:
    """One row: scanned, findings, errors, rejected, truncated."""
    return answered.agg(*(c.alias(n) for n, c in _counts().items()))


def observed(answered: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """answered, and the same counters, known when it has been written: no second pass."""
    seen = Observation(name)
    return answered.observe(seen, *(c.alias(n) for n, c in _counts().items())), seen


def serve(requests: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, most: int = MOST_REQUESTS, on_counts: Callable[[dict], None] | None = None, **rules):
    """A query over a stream of requests: each batch is admitted, scanned, and handed to write(answers, batch)."""

    def batch(rows: DataFrame, k: int) -> None:
        out, seen = observed(answers(admitted(rows, most), **rules), f"scan-{k}")
        write(out, k)
        if on_counts is not None:
            on_counts(seen.get)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
