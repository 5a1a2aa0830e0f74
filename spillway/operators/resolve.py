"""Overlaps, collisions and caps (WIN-01 to WIN-04, TOP-01), as Columns and windows."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.detect.words import GENERIC_LAST, MATCH_CAP

SPAN = "struct<start:int,stop:int,confidence:double,type:string>"
#: Lists of up to so many spans are resolved by a native fold, which takes squares of it.
NATIVE = 64


def _native(spans: Column, most: int) -> Column:
    def before(a: Column, b: Column) -> Column:
        first = lambda x, y: F.when(x < y, -1).when(x > y, 1)
        return F.coalesce(first(b["confidence"], a["confidence"]), first(a["start"], b["start"]), first(b["stop"], a["stop"]), first(a["type"], b["type"]), F.lit(0))

    kept = F.aggregate(
        F.array_sort(spans, before), F.expr(f"cast(array() as array<{SPAN}>)"),
        lambda out, m: F.when((F.size(out) >= most) | F.exists(out, lambda k: (k["start"] < m["stop"]) & (m["start"] < k["stop"])), out).otherwise(F.array_append(out, m)),
    )
    return F.array_sort(kept, lambda a, b: (a["start"] - b["start"]).cast("int"))


def _many(most: int):
    @F.arrow_udf(f"array<{SPAN}>")
    def run(spans: pa.Array) -> pa.Array:
        out = []
        for group in spans.to_pylist():
            if group is None:
                out.append(None)
                continue
            starts: list[int] = []
            kept: list[dict] = []
            for m in sorted(group, key=lambda m: (-m["confidence"], m["start"], -m["stop"], m["type"])):
                if len(kept) >= most:
                    break
                i = bisect_left(starts, m["start"])
                if (i < len(kept) and kept[i]["start"] < m["stop"]) or (i and m["start"] < kept[i - 1]["stop"]):
                    continue
                starts.insert(i, m["start"])
                kept.insert(i, m)
            out.append(kept)
        return pa.array(out, spans.type)

    return run


def without_overlaps(spans: Column, most: int = MATCH_CAP) -> Column:
    """Of an array of SPAN those kept greedily by confidence, then place, then width; in order of place.

    An empty array stays empty and null null.  Long lists go to a kernel that searches by halves.
    """
    spans = spans.cast(f"array<{SPAN}>")
    short = F.size(spans) <= NATIVE
    return F.coalesce(_native(F.when(short, spans), most), _many(most)(F.when(~short, spans)))


_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def collisions(rows: DataFrame) -> DataFrame:
    """One of the rows of an (item_id, line, value): rows hold ord, stage, severity and confidence besides.

    The fold is a choice among two: the first template, unless a cascade row is proven by a
    checksum or strictly stronger.  Rows keep all their columns.
    """
    w = Window.partitionBy("item_id", "line", "value")
    rank = F.lit(-1)
    for s, k in _RANK.items():
        rank = F.when(F.col("severity") == s, k).otherwise(rank)
    rule = F.col("stage") == "rule"
    rows = rows.withColumn("__rank", rank)
    first = F.min(F.when(rule, F.struct("ord", "__rank", "confidence"))).over(w)
    own = F.max(F.when(~rule, F.struct("__rank", "confidence"))).over(w)
    proven = F.max(F.when(~rule, F.contains("stage", F.lit("checksum")))).over(w)
    cascade = first.isNull() | (own.isNotNull() & (F.coalesce(proven, F.lit(False)) | (own["__rank"] > first["__rank"]) | ((own["__rank"] == first["__rank"]) & (own["confidence"] > first["confidence"]))))
    k = F.row_number().over(w.orderBy(F.when(rule == cascade, 1).otherwise(0), "ord"))
    return rows.withColumn("__k", k).where("__k = 1").drop("__k", "__rank")


_ORDER = ("line", "col", "type", "fingerprint")


def per_file_cap(findings: DataFrame, most: int = 30) -> DataFrame:
    """At most `most` generic entropy or password findings of a file and eight times as many of another type.  0: no cap."""
    if most <= 0:
        return findings
    limit = F.when(F.col("type").isin("generic_high_entropy", "generic_password"), most).otherwise(8 * most)
    k = F.row_number().over(Window.partitionBy("path", "type").orderBy(*_ORDER))
    # The plain bound comes first: it lets each task drop rows before they are shuffled, so a file of any size is no task's alone.
    return findings.withColumn("__k", k).where((F.col("__k") <= 8 * most) & (F.col("__k") <= limit)).drop("__k")


def dedupe(findings: DataFrame) -> DataFrame:
    """The first finding of each fingerprint, in order of path and place; those without one all stay."""
    k = F.row_number().over(Window.partitionBy("fingerprint").orderBy("path", *_ORDER))
    return findings.withColumn("__k", F.when(F.col("fingerprint").isNull(), 1).otherwise(k)).where("__k = 1").drop("__k")


def detector_order(detectors: DataFrame) -> DataFrame:
    """Structured types first, generic ones last."""
    return detectors.orderBy(F.col("id").isin(*GENERIC_LAST), "ord")
