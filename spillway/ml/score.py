"""Histogram gradient-boosted trees over feature vectors, and the gate they feed (ML-02 to ML-04, FLT-30)."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spillway.functions.entropy import profiles
from spillway.functions.text import has_any
from spillway.ml.features import ENTROPIES, NAMES, RATIO, vector

THRESHOLD = 0.3


class Model:
    """Trees as flat arrays.  A value of at most the threshold goes left; a missing one goes where the node says."""

    def __init__(self, doc: dict | str):
        doc = json.loads(doc) if isinstance(doc, str) else doc
        if tuple(doc["feature_names"]) != NAMES:
            raise ValueError("the model's features aren't the 49 of this engine")
        self.baseline = float(doc["baseline"])
        self.trees = []
        for t in doc["trees"]:
            cols = {k: np.asarray(t[k]) for k in ("feature_idx", "threshold", "left", "right", "value", "missing_left", "is_leaf")}
            n = len(cols["value"])
            if not n or any(len(c) != n for c in cols.values()):
                raise ValueError("a tree's columns differ in length, or it is empty")
            inner = ~cols["is_leaf"].astype(bool)
            for side in ("left", "right"):
                child = cols[side][inner]
                if len(child) and (child.min() < 0 or child.max() >= n):
                    raise ValueError("a child outside its tree")
            if inner.any() and (cols["feature_idx"][inner].min() < 0 or cols["feature_idx"][inner].max() >= len(NAMES)):
                raise ValueError("a feature outside the vector")
            self.trees.append(cols)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows; a walk longer than its tree has nodes ends where it is, with nothing added."""
        total = np.full(len(x), self.baseline)
        rows = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            leaf = t["is_leaf"].astype(bool)
            for _ in range(len(leaf)):
                go = ~leaf[node]
                if not go.any():
                    break
                v = x[rows, t["feature_idx"][node]]
                left = np.where(np.isnan(v), t["missing_left"][node].astype(bool), v <= t["threshold"][node])
                node = np.where(go, np.where(left, t["left"][node], t["right"][node]), node)
            total += np.where(leaf[node], t["value"][node], 0.0)
        return 1 / (1 + np.exp(-total))


def _batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("__x")
            flat = np.array(batch.column(at).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, len(NAMES))
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(names.index("__v")).to_pylist()]
            flat[:, RATIO] = [len(zlib.compress(b, 6)) / len(b) if b else 0.0 for b in raw]
            flat[:, ENTROPIES] = profiles(batch.column(names.index("__v")))
            kept = [k for k, n in enumerate(names) if n not in ("__x", "__v")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(model.predict(flat), pa.float64())], [*(names[k] for k in kept), "score"])

    return run


def scored(rows: DataFrame, model: Model, value: Column, name: Column, line: Column, path: Column, source: Column) -> DataFrame:
    """rows with `score`, the probability that the value is a secret.  One pass of Python: the share that zlib leaves is taken there too."""
    wide = rows.withColumns({"__x": vector(value, name, line, path, source, ratio=False), "__v": value})
    return wide.mapInArrow(_batches(model), StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def exempt(kind: Column, stage: Column) -> Column:
    """Findings that are proven, or keys: the model never drops them."""
    k = F.lower(kind)
    return F.contains(stage, F.lit("checksum")) | has_any(k, ("pem", "pgp", "pkcs", "service_account", "service-account")) | (F.contains(k, F.lit("private")) & F.contains(k, F.lit("key")))


def gated(hits: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of scan.raw() that are exempt or score the threshold, with their score."""
    value = F.make_valid_utf8(F.substring(F.encode("value", "UTF-8"), 1, 512).cast("string"))
    rows = scored(hits, model, value, F.col("name"), F.col("text"), F.col("path"), F.col("source"))
    return rows.where(exempt(F.col("type"), F.col("stage")) | (F.col("score") >= threshold) | F.col("type").isin("results_truncated", "scan_failed"))


MOST_REMOTE = 200  # an item with more findings than that isn't sent


def gated_by(hits: DataFrame, ask, threshold: float = THRESHOLD, most: int = MOST_REMOTE) -> DataFrame:
    """Rows of scan.raw() that are exempt or score the threshold by a scorer of the caller's.

    ask(rows) takes a batch's rows (value, name, line, path, source) and gives their scores.
    What can't be scored stays, with a null score: a batch whose scorer fails, and the findings
    of an item that has more than `most`.
    """
    from pyspark.sql import Window

    many = F.count(F.lit(1)).over(Window.partitionBy("item_id")) > most
    sent = ~many & ~exempt(F.col("type"), F.col("stage")) & ~F.col("type").isin("results_truncated", "scan_failed")
    rows = hits.withColumn("__send", sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(np.asarray(batch.column(batch.schema.names.index("__send"))))
            score = np.full(batch.num_rows, np.nan)
            if len(at):
                some = batch.take(pa.array(at))
                told = [{k: some.column(some.schema.names.index(c))[i].as_py() for k, c in (("value", "value"), ("name", "name"), ("line", "text"), ("path", "path"), ("source", "source"))} for i in range(len(at))]
                try:
                    got = np.asarray(ask(told), float)
                    if got.shape == (len(at),):
                        score[at] = got
                except Exception:  # open: a scorer that is away drops nothing
                    pass
            kept = [k for k, n in enumerate(batch.schema.names) if n != "__send"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(score, pa.float64(), from_pandas=True)], [*(batch.schema.names[k] for k in kept), "score"])

    scored_ = rows.mapInArrow(run, StructType([*hits.schema.fields, StructField("score", DoubleType())]))
    return scored_.where(F.col("score").isNull() | (F.col("score") >= threshold))
