"""Items from files: folders, lists, stdin, target lists (SRC-01 to SRC-04, SRC-18, SRC-27, SRC-28)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.detect.dialect import path_regex
from spillway.functions.filters import matches_path
from spillway.sources.content import normalized, source_of, text_of

MOST_BYTES = 10 << 20
SKIP_FOLDERS = tuple(sorted(".git .hg .svn .venv __pycache__ bower_components node_modules target vendor venv".split()))
BINARY = tuple(sorted(
    "7z a avi bin bmp bz2 class dll dylib eot exe flac gif gz ico jar jpeg jpg mkv mov mp3 mp4 o otf pdf png pyc rar so tar tgz tif ttf wav webm webp woff woff2 xz zip zst".split()
))


def _named(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def _wanted(path: Column, length: Column, exclude, most_bytes: int, root: str = "") -> Column:
    """Paths worth reading, told from their names and sizes alone, so contents aren't read for the others."""
    inner = F.replace(path, F.lit(root), F.lit("")) if root else path
    keep = length.between(1, most_bytes) & ~F.lower(path).rlike(r"\.(?:" + "|".join(BINARY) + r")\z")
    keep = keep & ~F.arrays_overlap(F.split(inner, "/"), F.array(*map(F.lit, SKIP_FOLDERS)))
    for pattern in exclude:
        keep = keep & ~matches_path(path, pattern)
    return keep


def binary_files(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """path, length, content of files at local or object-store paths."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))


def items(files: DataFrame, exclude=(), most_bytes: int = MOST_BYTES, root: str = "") -> DataFrame:
    """Items of binary_files() rows: texts of fit files, with source by extension.

    A folder named as the root is read even if its name is one that is skipped below it.
    """
    path = _named(F.col("path"))
    fit = files.where(_wanted(path, F.col("length"), exclude, most_bytes, root))
    return _items(fit, normalized(F.col("content")))


def _items(files: DataFrame, text: Column) -> DataFrame:
    path = _named(F.col("path"))
    return files.select(F.xxhash64("path").alias("item_id"), text.alias("text"), source_of(path).alias("source"), path.alias("path"), F.lit(None).cast("map<string,string>").alias("meta")).where("text IS NOT NULL")


def resolved(root: str) -> str:
    """A local root that is itself a link leads to what it names; links below a root are never followed."""
    path = root.removeprefix("file://")
    return os.path.realpath(path) if os.path.islink(path.rstrip("/")) else root


def _passed_over(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")) and not name.startswith(("_common_metadata", "_metadata"))


def _folders(root: str) -> tuple[list[str], int]:
    """A local root and the folders below it, without links and those that are skipped, and how many entries they have."""
    out, n = [root], 0
    for at in out:  # which grows
        with os.scandir(at) as entries:
            for e in entries:
                n += 1
                if e.is_dir(follow_symlinks=False) and e.name not in SKIP_FOLDERS and not _passed_over(e.name):
                    out.append(e.path)
    return out, n


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names, sizes = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(["file:" + n.decode("utf-8", "replace") for n in names], pa.string()), pa.array(sizes, pa.int64())], ["name", "path", "length"])

    for b in batches:
        for at in b.column(0).to_pylist():
            rows = []
            with os.scandir(at) as entries:
                for e in entries:
                    if e.is_file(follow_symlinks=False) and not _passed_over(os.fsdecode(e.name)):
                        rows.append((e.path, e.stat(follow_symlinks=False).st_size))
                        if len(rows) >= BATCH_ROWS:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "text"])

    for b in batches:
        rows, held = [], 0
        for name, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with open(name, "rb") as f:
                text = text_of(f.read())
            if text is None:
                continue
            rows.append((path, text))
            held += len(text)
            if held > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


BATCH_ROWS, BATCH_BYTES, TASK_FILES = 5000, 4 << 20, 2000


def local_items(spark: SparkSession, root: str, exclude=(), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Items of a local folder that all executors see; links below it aren't followed.

    The driver learns the folders alone; executors list them and read the files, so many for
    a task: Spark's own reader counts any file as some megabytes, which makes a task for a few.
    """
    folders, entries = _folders(root)
    spread = max(spark.sparkContext.defaultParallelism, entries // TASK_FILES)
    names = spark.createDataFrame([(bytearray(os.fsencode(f)),) for f in folders], "folder binary").repartition(min(spread, len(folders))).mapInArrow(_list, "name binary, path string, length long")
    fit = names.where(_wanted(_named(F.col("path")), F.col("length"), exclude, most_bytes, root)).select("name", "path")
    return _items(fit.repartition(spread, "name").mapInArrow(_read, "path string, text string"), F.col("text"))


def folder(spark: SparkSession, root: str, exclude=(), most_bytes: int = MOST_BYTES) -> DataFrame:
    root = resolved(root).rstrip("/")
    local = re.sub("^file:/+", "/", root)
    if os.path.isdir(local):
        return local_items(spark, local, exclude, most_bytes)
    return items(binary_files(spark, root), exclude, most_bytes, root)


def file_list(spark: SparkSession, paths, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Items of the files named, whatever their extension; a link that is named is followed."""
    paths = [resolved(p) for p in paths]
    files = binary_files(spark, *paths, recursive=False).where(F.col("length").between(1, most_bytes))
    return _items(files, normalized(F.col("content")))


def stdin(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text, "code", "<stdin>", None)], "item_id long, text string, source string, path string, meta map<string,string>")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Hosts of a list: a line each, without comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("target")).where("target != '' AND NOT startswith(target, '#')").distinct()


def total_bytes(files: DataFrame, budget: int) -> DataFrame:
    """Files in order of path as far as their sizes fit the budget, by the sum over the table.

    Names are cut into ranges; each range's total gives the sum before it, so no task has all
    names.  Ranges are told by their first names, which come from the names themselves.
    """
    sizes = files.select("path", "length")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = sorted({r[0] for r in sizes.where(F.pmod(F.xxhash64("path"), F.lit(CUT_EVERY)) == 0).select("path").orderBy(F.xxhash64("path", F.lit(1))).limit(parts - 1).collect()})
    part = F.aggregate(F.array(*map(F.lit, first)), F.lit(0), lambda n, x: n + F.when(x <= F.col("path"), 1).otherwise(0)) if first else F.lit(0)
    rows = sizes.withColumn("__part", part)
    totals = rows.groupBy("__part").agg(F.sum("length").alias("__bytes"))
    before = {r["__part"]: r["__bytes"] for r in totals.collect()}
    start, at = {}, 0
    for k in range(len(first) + 1):
        start[k] = at
        at += before.get(k, 0)
    base = F.element_at(F.array(*(F.lit(start[k]).cast("long") for k in range(len(first) + 1))), F.col("__part") + 1)
    inside = F.sum("length").over(Window.partitionBy("__part").orderBy("path"))
    fit = rows.withColumn("__sum", base + inside).where(F.col("__sum") <= budget).select("path")
    return files.join(fit, "path", "left_semi")


CUT_EVERY = 97  # a name in so many may be a cut

def download(url: str, to: str, read, most_bytes: int = 512 << 20) -> str:
    """A file of an https URL, of so many bytes at most, by the caller's read(url), which gives blocks of bytes."""
    if not url.lower().startswith("https://"):
        raise ValueError(f"not an https URL: {url!r}")
    n = 0
    try:
        with open(to, "wb") as f:
            for block in read(url):
                n += len(block)
                if n > most_bytes:
                    raise ValueError(f"more than {most_bytes} bytes")
                f.write(block)
    except BaseException:
        if os.path.exists(to):
            os.remove(to)
        raise
    return to


CORPUS = "value string, text string, source string, origin string, label_binary byte, label_type string, context struct<line:string,name:string,path:string,source:string>, span array<long>, extra string"


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled records of a JSON-lines file in a fixed schema; what else a record holds stays in `extra`."""
    raw = spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("__line"))
    known = "value string, text string, source string, origin string, label_binary string, label_type string, context struct<line:string,name:string,path:string,source:string>, span array<long>, extra string"
    rows = raw.withColumns({"r": F.from_json("__line", known), "all": F.from_json("__line", "map<string,string>")})
    names = ("value", "text", "source", "origin", "label_binary", "label_type", "context", "span", "extra")
    other = F.map_filter("all", lambda k, v: ~k.isin(*names))
    label = F.when(F.lower("r.label_binary").isin("1", "true"), 1).when(F.lower("r.label_binary").isin("0", "false"), 0).cast("byte")
    extra = F.when(F.size(other) > 0, F.to_json(other)).otherwise(F.col("r.extra"))
    return rows.select("r.value", "r.text", "r.source", "r.origin", label.alias("label_binary"), "r.label_type", "r.context", "r.span", extra.alias("extra"))


__all__ = ["binary_files", "file_list", "folder", "items", "labelled_corpus", "local_items", "path_regex", "stdin", "targets", "total_bytes"]
