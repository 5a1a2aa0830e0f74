"""Substring dedup by difference-cover anchors.

A repeat is a run of LENGTH words that occurs at two places of the corpus, in one document or
in two.  repeats() returns, for each document, the spans of words that such runs cover: those
whose place is the first of its run in the order of (doc_id, word), and those that repeat an
earlier place (`later`).

COVER is a difference cover modulo PERIOD: for any two places i and j there is a shift below
PERIOD that takes both to residues of the cover.  So two equal runs of LENGTH words share a
window of LENGTH - PERIOD + 1 words that starts, in both, at a cover position the same
distance from the runs' starts.  Only windows at cover positions are hashed (6 in 31), and
only those that occur twice are kept; every repeat holds one.  An anchor then extends: each
run of LENGTH words that contains it is hashed whole, and is a repeat if that hash, of 64
bits, is found at another place.  Nothing is compared pair by pair, so a passage in a
million documents costs a million rows.

Windows are counted with partial sums before they are shuffled.  Those of more than one in
SHARES of all are hot, so there are SHARES of them at most; a run that begins with one is hot,
and the places of a hot run are ordered in parts (hot.py), so no task has them all.

Defined cases: null texts and texts of fewer than LENGTH words have no repeats; rows of null
doc_id are left out; rows that repeat a doc_id are places of the one document, and so repeat
each other; overlapping places of a periodic text count as different places; a very long text
is read whole; an empty table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.hot import among, bits, lookup, places
from spillway.llm.store import Store
from spillway.llm.tokens import Words, signed, slices

LENGTH = 50
SHARES, LEAST_HOT = 50_000, 1000
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS w FROM {{docs}} WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, unnest(range(1, len(w) - {LENGTH - 2})) AS i, w FROM w WHERE len(w) >= {LENGTH}),
k AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i : i + {LENGTH - 1}], ' ') AS s FROM p),
r AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later, COUNT(*) OVER (PARTITION BY s) AS n FROM k),
m AS (SELECT doc_id, later, i, i > COALESCE(LAG(i) OVER (PARTITION BY doc_id, later ORDER BY i), -1000) + {LENGTH} AS fresh FROM r WHERE n > 1),
g AS (SELECT *, SUM(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, later ORDER BY i) AS g FROM m)
SELECT doc_id, later, CAST(MIN(i) AS INT) AS start_word, CAST(MAX(i) + {LENGTH} AS INT) AS end_word FROM g GROUP BY doc_id, later, g
"""


def _anchors(length: int, period: int, cover: tuple[int, ...], seen=None):
    """h of each window at a cover position; with `seen`, h, doc_id and place of those that may be among the seen."""
    size = length - period + 1
    inside = np.zeros(period, bool)
    inside[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1))
                if not len(words.hash):
                    continue
                doc = words.doc()
                place = np.arange(len(doc)) - words.at[doc]
                ok = np.flatnonzero(inside[place % period] & (place + size <= words.counts()[doc]) & (words.counts()[doc] >= length))
                h = signed(words.windows(size))[ok]
                if seen is None:
                    if len(ok):
                        yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])
                    continue
                again = lookup(seen.value, h)
                h, ok = h[again], ok[again]
                if len(ok):
                    yield pa.RecordBatch.from_arrays([pa.array(h), part.column(0).take(pa.array(doc[ok])), pa.array(place[ok].astype(np.int32))], ["h", "doc_id", "place"])

    return run


def _extend(length: int, period: int, hot):
    """All runs of `length` words around the anchors of each document, and whether they begin with a hot window."""
    size = length - period + 1
    back = length - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1))
                n = len(words.hash)
                if not n:
                    continue
                anchors = part.column(2)
                many = np.diff(np.asarray(anchors.offsets))
                doc = np.repeat(np.arange(part.num_rows), many)
                at = np.minimum(words.at[doc] + np.asarray(anchors.flatten()), n - 1)  # rows may share a doc_id
                delta = np.zeros(n + 1, np.int32)  # starts from anchor - back to anchor, by prefix sums
                np.add.at(delta, np.maximum(at - back, words.at[doc]), 1)
                np.add.at(delta, at + 1, -1)
                doc = words.doc()
                place = np.arange(n) - words.at[doc]
                ok = np.flatnonzero((np.cumsum(delta[:n]) > 0) & (place + length <= words.counts()[doc]))
                h = signed(words.windows(length))[ok]
                many = among(hot.value, signed(words.windows(size))[ok])
                ids, place = part.column(0).take(pa.array(doc[ok])), place[ok].astype(np.int32)
                for lo in range(0, len(ok), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + 100_000]), ids.slice(lo, 100_000), pa.array(place[lo : lo + 100_000]), pa.array(many[lo : lo + 100_000])], ["h", "doc_id", "place", "hot"])

    return run


def spans(runs: DataFrame, length: int) -> DataFrame:
    """doc_id, later, start_word, end_word: runs (doc_id, later, lo, hi: first and last start) united where they touch."""
    order = Window.partitionBy("doc_id", "later").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("lo") > F.coalesce(before, F.lit(-(10**6))) + length, 1).otherwise(0)
    return (
        runs.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "later", "g").agg(F.min("lo").cast("int").alias("start_word"), (F.max("hi") + length).cast("int").alias("end_word"))
        .drop("g")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc_id, later, place) to runs of consecutive places; a run cut by a batch is united later."""
    for batch in batches:
        n = batch.num_rows
        if n:
            doc, later, place = (np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), np.asarray(batch.column(2)))
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (later[1:] != later[:-1]) | (place[1:] > place[:-1] + 1)])
            end = np.r_[new[1:], n] - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(later[new]), pa.array(place[new]), pa.array(place[end])], ["doc_id", "later", "lo", "hi"])


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, later, start_word, end_word (past the last) of all repeated spans."""
    store = Store(spark)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = texts.mapInArrow(_anchors(length, period, cover), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = store.table(counts, "windows")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.sort(counts.where(F.col("n") > max(LEAST_HOT, total // SHARES)).select("h").toArrow().column("h").to_numpy())
    hot, seen = (spark.sparkContext.broadcast(x) for x in (hot, bits(counts, "h")))
    anchors = texts.mapInArrow(_anchors(length, period, cover, seen), "h long, doc_id long, place int").join(counts, "h", "left_semi")
    anchors = store.table(anchors.select("doc_id", "place"), "anchors")
    by_doc = anchors.groupBy("doc_id").agg(F.collect_set("place").alias("anchors"))
    cand = texts.join(by_doc, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_extend(length, period, hot), "h long, doc_id long, place int, hot boolean")
    found = places(store, cand)
    store.drop("windows", "anchors")
    found = found.repartition("doc_id").sortWithinPartitions("doc_id", "later", "place")
    return spans(found.mapInArrow(_runs, "doc_id long, later boolean, lo int, hi int"), length)
