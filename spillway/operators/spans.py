"""Spans of patterns in native expressions: rules are rows, and Catalyst plans the search (JN-01, JN-02, DET-03, DET-06).

The anchor join reads each text once, by an automaton of all anchors.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.detect.dialect import translate

OPEN, CLOSE = "\ue000", "\ue001"
#: Most anchors that are made into one automaton; a larger table is joined by its own plan.
ANCHORS = 200_000


def _present(words: tuple[str, ...]):
    """Numbers of the words that occur in a text, found in one reading of it."""

    @F.arrow_udf("array<int>")
    def run(low: pa.Array) -> pa.Array:
        automaton = _automaton(words)
        return pa.array([None if t is None else sorted({k for _, k in automaton.iter(t)}) for t in low.to_pylist()], pa.list_(pa.int32()))

    return run


@lru_cache(4)
def _automaton(words: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for k, w in enumerate(words):
        a.add_word(w, k)
    a.make_automaton()
    return a


def anchored(items: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id and id of each rule of which an anchor occurs in the item, and of each rule without anchors.

    rules: id and anchors.  Each text is read once, by an automaton of all anchors, so the time
    doesn't grow with their number; texts aren't moved.
    """
    low = items.select("item_id", F.lower("text").alias("low")).where("low IS NOT NULL")
    named = rules.select("id", F.explode("anchors").alias("anchor")).select("id", F.lower("anchor").alias("anchor"))
    words = [r.anchor for r in named.where("anchor != ''").select("anchor").distinct().limit(ANCHORS + 1).collect()]
    if len(words) > ANCHORS:
        hit = low.join(named, F.contains("low", "anchor")).select("item_id", "id").distinct()
    elif words:
        words.sort()
        at = rules.sparkSession.createDataFrame(list(enumerate(words)), "k int, anchor string")
        of = F.broadcast(at.join(named, "anchor").groupBy("k").agg(F.collect_set("id").alias("ids")))  # as many rows as words
        hit = low.select("item_id", F.explode(_present(tuple(words))("low")).alias("k")).join(of, "k").select("item_id", F.explode("ids").alias("id")).distinct()
    else:
        hit = low.select("item_id", F.lit(None).cast(rules.schema["id"].dataType).alias("id")).limit(0)
    return hit.unionByName(low.select("item_id").crossJoin(rules.where(F.size("anchors") == 0).select("id")))


def marked(text: Column, before: str, value: str, after: str = "") -> Column:
    """Byte spans of `value` between `before` and `after`, as array of (start, stop, value).

    The pattern is cut in three so that a replacement can mark the value; offsets are sums of
    the pieces' lengths.  Inner groups must not capture.
    """
    clean = F.regexp_replace(text, f"[{OPEN}{CLOSE}]", "?")
    rx = translate(f"({before})({value})({after})", java=True)
    pieces = F.split(F.regexp_replace(clean, F.lit(rx), F.lit(f"$1{OPEN}$2{CLOSE}$3")), OPEN)
    step = F.aggregate(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.octet_length(F.get(pieces, 0)).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.octet_length(p) - F.octet_length(F.lit(CLOSE))).alias("at"),
            F.array_append(a["out"], F.struct(a["at"].alias("start"), (a["at"] + F.octet_length(F.substring_index(p, CLOSE, 1))).alias("stop"), F.substring_index(p, CLOSE, 1).alias("value"))).alias("out"),
        ),
    )
    return F.when(text.isNotNull(), step["out"])


def runs(text: Column, kind: str = "[A-Za-z0-9+/]{32,}") -> Column:
    """Maximal runs of a class."""
    return marked(text, "", kind)


def lines(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id, line from 1, the byte at which it starts, and the line itself."""
    rows = items.select("item_id", F.posexplode(F.split(F.col(text), "\n")).alias("k", "line_text"))
    from pyspark.sql import Window

    at = F.sum(F.octet_length("line_text") + 1).over(Window.partitionBy("item_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("item_id", (F.col("k") + 1).alias("line"), F.coalesce(at, F.lit(0)).alias("start"), "line_text")
