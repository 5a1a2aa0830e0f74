"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and test items are reduced to lower-case words of letters and digits, one space apart
and at both ends.  Test strings are all runs of WORDS words of an item, or the whole item if
it has fewer.  leaks() reports items of any length, with their number of words; without_leaks()
removes documents for items of MIN_WORDS words and more, as a shorter one (a parameter) can't
tell a leak from common speech.

Test strings are searched in classes of length.  In a class whose shortest string has m
bytes, the shift table gives, for the hash of the last `block` bytes of a window of m bytes,
how far the window can move without passing an occurrence.  Where that is 0, the hash selects
the bucket of test strings whose first m bytes end so, and each is compared with the text.
Windows of many stretches of a batch move in lockstep, so no Python loop runs over bytes.

The tables hold the benchmark alone, never the corpus.  About STRINGS test strings are in
memory at once, on the driver too; a larger benchmark is searched in several passes, each with
the strings of one value of a hash.

Defined cases: null and empty texts, and items without words, hold nothing and are found
nowhere; a row that repeats a doc_id and text counts once, of several texts of a doc_id leaks()
gives the most strings that one of them holds; a null doc_id is reported as null; very long
texts are searched whole; items of equal text each get a row; an empty corpus or benchmark gives
no rows.  Other columns are neither read nor returned by leaks(), and kept by without_leaks(),
which decides each row by its own text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.tokens import raw, slices

WORDS, MIN_WORDS = 13, 5
STRINGS = 500_000
STRETCH = 2048
_TABLE = 1 << 20

SQL = f"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{{{L}}}}\\p{{{{N}}}}]+') AS w FROM {{benchmark}}),
p AS (SELECT DISTINCT item_id, ' ' || unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) END) || ' ' AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, MAX(len(w)) AS item_words FROM b GROUP BY 1),
d AS (SELECT doc_id, text, ' ' || trim(regexp_replace(lower(text), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' ', 'g')) || ' ' AS t FROM {{docs}} WHERE text IS NOT NULL),
f AS (SELECT doc_id, item_id, COUNT(DISTINCT s) AS strings FROM d JOIN p ON contains(t, s) GROUP BY doc_id, text, item_id)
SELECT doc_id, f.item_id, CAST(MAX(item_words) AS INT) AS item_words, CAST(MAX(strings) AS BIGINT) AS strings FROM f JOIN n ON f.item_id IS NOT DISTINCT FROM n.item_id GROUP BY 1, 2
"""


def words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))


class Search:
    """Wu-Manber tables of one class of byte strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.m = min(map(len, strings))
        self.block = 8 if self.m >= 32 else 4 if self.m >= 12 else 2
        self.shift = np.full(_TABLE, self.m - self.block + 1, np.int32)
        head = np.frombuffer(b"".join(s[: self.m] for s in strings), np.uint8).reshape(len(strings), self.m)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self._hash(head[:, end - self.block : end]), self.m - end)
        self.buckets: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for h, (i, s) in zip(self._hash(head[:, self.m - self.block :]).tolist(), enumerate(strings)):
            self.buckets[h].append((i, s))

    def _hash(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), 8), np.uint8)
        wide[:, : self.block] = x
        return ((wide.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, number of the string) of each occurrence."""
        n = len(data) - self.m + 1
        if n <= 0:
            return
        at = np.arange(0, n, STRETCH)
        end = np.minimum(at + STRETCH, n)
        take = np.arange(self.m - self.block, self.m)
        text = data.tobytes()
        while len(at):
            h = self._hash(data[at[:, None] + take])
            step = self.shift[h]
            for a, x in zip(at[step == 0].tolist(), h[step == 0].tolist()):
                for i, s in self.buckets.get(x, ()):
                    if text.startswith(s, a):
                        yield a, i
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]


def searches(strings: list[bytes]) -> list[tuple[Search, list[int]]]:
    """A search for each class of length, with the numbers of its strings."""
    by = defaultdict(list)
    for i, s in enumerate(strings):
        by[min(len(s), 64).bit_length()].append(i)
    return [(Search([strings[i] for i in of]), of) for of in by.values()]


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, its words, and their number."""
    w = F.split(F.trim(words(F.col("text"))), " ")
    return benchmark.where("text IS NOT NULL").select("item_id", w.alias("w")).where("w[0] != ''").withColumn("n", F.size("w"))


def _tables(spark: SparkSession, items: DataFrame) -> Iterator:
    """Broadcast searches and owners (numbers of item_ids) of about STRINGS test strings at a time."""
    run = F.expr(f"transform(sequence(0, n - {WORDS}), i -> array_join(slice(w, i + 1, {WORDS}), ' '))")
    strings = items.select("item_id", F.explode(F.when(F.col("n") < WORDS, F.array(F.array_join("w", " "))).otherwise(run)).alias("s")).distinct()
    turns = max(1, -(-strings.count() // STRINGS))
    for turn in range(turns):
        owners = defaultdict(list)
        for item, s in strings.where(F.pmod(F.xxhash64("s"), F.lit(turns)) == turn).toLocalIterator():
            owners[f" {s} ".encode()].append(item)
        names = sorted(owners)
        yield spark.sparkContext.broadcast((searches(names), [owners[s] for s in names]))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, the item's words, and how many different test strings of it the document holds."""
    items = _items(benchmark)
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("text"))
    found = None
    for turn, tables in enumerate(_tables(spark, items)):
        now = texts.mapInArrow(_scan(tables), "doc_id long, h long, item_id long, strings long").withColumn("turn", F.lit(turn))
        found = now if found is None else found.unionByName(now)
    # Rows that repeat agree within a pass; the strings of an item may lie in several passes.
    found = found.groupBy("doc_id", "h", "item_id", "turn").agg(F.max("strings").alias("strings")).groupBy("doc_id", "h", "item_id").agg(F.sum("strings").alias("strings"))
    found = found.groupBy("doc_id", "item_id").agg(F.max("strings").alias("strings"))
    length = items.groupBy(F.col("item_id").alias("of")).agg(F.max("n").alias("item_words"))
    return found.join(length, found["item_id"].eqNullSafe(length["of"])).select("doc_id", "item_id", "item_words", "strings")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the rows whose text holds a test string of an item of min_words words or more; no row is moved."""
    for tables in _tables(spark, _items(benchmark).where(F.col("n") >= min_words)):
        docs = docs.where(~_holds(tables)(words(F.coalesce("text", F.lit("")))))
    return docs


def _hits(tables, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list, int]]:
    """Text, items and number of each test string that occurs, as often as it does."""
    found, owners = tables
    for search, of in found:
        for start, i in search.find(data):
            doc = int(np.searchsorted(off, start, "right")) - 1
            if start + len(search.strings[i]) <= off[doc + 1]:
                yield doc, owners[of[i]], of[i]


def _holds(tables):
    @F.arrow_udf("boolean")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"])):
            data, off = raw(part.column(0))
            has = np.zeros(part.num_rows, bool)
            has[[doc for doc, *_ in _hits(tables.value, data, off)]] = True
            out.append(has)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return run


def _scan(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, off = raw(part.column(2))
                hits: dict[tuple[int, int | None], set] = defaultdict(set)
                for doc, items, string in _hits(tables.value, data, off):
                    for item in items:
                        hits[doc, item].add(string)
                if hits:
                    at = pa.array([d for d, _ in hits])
                    counts = [pa.array([i for _, i in hits], pa.int64()), pa.array([len(x) for x in hits.values()], pa.int64())]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *counts], ["doc_id", "h", "item_id", "strings"])

    return run
