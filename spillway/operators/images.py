"""Flattening of container image layers (WIN-06, JN-11, JN-12, AGG-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"
MOST_BYTES, MOST_ENTRIES, MOST_PATHS = 2 << 30, 500_000, 300_000


def events(entries: DataFrame) -> DataFrame:
    """label, layer, seq, path, kind of tar entries: add, delete (of a path) or opaque (of a folder's contents)."""
    base = F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise(F.lit(""))
    target = F.expr(f"substring(substring_index(path, '/', -1), {len(WHITEOUT) + 1})")
    kind = F.when(base == OPAQUE, "opaque").when(base == WHITEOUT, "none").when(F.startswith(base, F.lit(WHITEOUT)), "delete").otherwise("add")
    path = F.when(kind == "opaque", folder).when(kind == "delete", F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))).otherwise(F.col("path"))
    return entries.select("label", "layer", "seq", path.alias("path"), kind.alias("kind")).where("kind != 'none'")


def owners(events: DataFrame) -> DataFrame:
    """label, path and the layer whose entry is in the final image.

    The last addition of a path counts.  It is gone if a higher layer deletes it, or a folder
    above it, or makes such a folder opaque, or if its own layer deletes it afterwards.
    Whiteouts reach paths below them by a join on the path's own folders, not by comparing
    all pairs, so a label's cost is its paths times their depth.
    """
    adds = events.where("kind = 'add'").groupBy("label", "path").agg(F.max(F.struct("layer", "seq")).alias("a")).select("label", "path", "a.layer", "a.seq")
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = adds.withColumn("target", F.explode(F.array_distinct(ups)))
    outs = events.where("kind IN ('delete', 'opaque')").groupBy("label", F.col("path").alias("target"), "kind").agg(F.max("layer").alias("top"), F.max(F.struct("layer", "seq")).alias("last"))
    own = F.col("target") == F.col("path")
    kills = ((F.col("kind") == "delete") & ((F.col("top") > F.col("layer")) | (own & (F.col("last") > F.struct("layer", "seq"))))) | ((F.col("kind") == "opaque") & ~own & (F.col("top") > F.col("layer")))
    dead = above.join(outs, ["label", "target"]).where(kills).select("label", "path").distinct()
    return adds.join(dead, ["label", "path"], "left_anti").select("label", "path", "layer")


def parse_path(findings: DataFrame) -> DataFrame:
    """label, layer and file of a finding's path, null if it isn't in a layer."""
    rx = r"^(?s)(.*?)\|layer([0-9]+):(.*)\z"
    hit = F.col("path").rlike(rx)
    return findings.withColumns({"__label": F.when(hit, F.regexp_extract("path", rx, 1)), "__layer": F.when(hit, F.regexp_extract("path", rx, 2).cast("int")), "__file": F.when(hit, F.regexp_extract("path", rx, 3))})


def mark_final(findings: DataFrame, owners: DataFrame, degraded: DataFrame | None = None) -> DataFrame:
    """in_final_image of findings in layers; null for other findings, unknown labels and labels whose layers weren't all read."""
    known = owners.select(F.col("label").alias("__known")).distinct()
    if degraded is not None:
        known = known.join(degraded.select(F.col("label").alias("__known")), "__known", "left_anti")
    own = owners.select(F.col("label").alias("__l"), F.col("path").alias("__p"), F.col("layer").alias("__owner"))
    rows = parse_path(findings).drop("in_final_image")
    rows = rows.join(known, rows["__label"] == F.col("__known"), "left").join(own, (F.col("__label") == F.col("__l")) & (F.col("__file") == F.col("__p")), "left")
    final = F.when(F.col("__known").isNotNull(), F.coalesce(F.col("__owner") == F.col("__layer"), F.lit(False)))
    return rows.withColumn("in_final_image", final).drop("__label", "__layer", "__file", "__known", "__l", "__p", "__owner")


def instructions(layers: DataFrame, history: DataFrame) -> DataFrame:
    """label, layer, instruction: the k-th step that makes a layer made layer k; null unless a label has as many as layers.

    layers: label, layer.  history: label, step, created_by, empty_layer.
    """
    steps = history.where("NOT coalesce(empty_layer, false)")
    steps = steps.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("step")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("label")))
    rows = layers.select("label", "layer").distinct()
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("layer")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("label")))
    return rows.join(steps.select("label", "k", "n", F.col("created_by").alias("instruction")), ["label", "k", "n"], "left").select("label", "layer", "instruction")


def budget(entries: DataFrame, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Entries of each label as far as its budget of bytes and entries goes, with `aborted` where it was cut."""
    w = Window.partitionBy("label").orderBy("layer", "seq")
    rows = entries.withColumns({"__bytes": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.row_number().over(w)})
    over = (F.col("__bytes") > most_bytes) | (F.col("__n") > most_entries)
    rows = rows.withColumn("aborted", F.coalesce(F.bool_or(over).over(Window.partitionBy("label")), F.lit(False)))
    return rows.where(~over).drop("__bytes", "__n")
