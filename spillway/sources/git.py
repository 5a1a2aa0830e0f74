"""Items from git: changed files and every blob of the history (SRC-08 to SRC-10), as a Spark data source."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spillway.detect.dialect import path_matches
from spillway.services.resilience import retry
from spillway.sources.content import normalized, source_of
from spillway.sources.files import BINARY, MOST_BYTES

_URL = re.compile(r"(?:https?|ssh|git)://[^\s]+|[\w.\-]+@[\w.\-]+:[^\s]+")
BLOBS = 2000


def _git(folder: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "protocol.ext.allow=never", "-C", folder, *args], input=stdin, capture_output=True, check=True).stdout


def _safe(rev: str) -> str:
    if rev.startswith("-") or not rev.strip():
        raise ValueError(f"not a revision: {rev!r}")
    return rev


def changed_files(folder: str, since: str | None = None) -> list[str]:
    """Files added, copied, modified or renamed (by their new path) in the index, or since a revision."""
    args = ["diff", "--name-only", "-z", "--diff-filter=ACMR"] + ([_safe(since)] if since else ["--cached"]) + ["--"]
    top = _git(folder, "rev-parse", "--show-toplevel").decode().strip()
    return [f"{top}/{p}" for p in _git(folder, *args).decode("utf-8", "replace").split("\0") if p]


def clone(url: str, to: str, depth: int | None = 1) -> str:
    """A clone of a repository at a plain URL; depth None takes the whole history."""
    if _URL.fullmatch(url) is None:
        raise ValueError(f"not a repository URL: {url!r}")
    args = ["git", "-c", "protocol.ext.allow=never", "clone", "--quiet", *([f"--depth={depth}"] if depth else []), "--", url, to]
    retry(lambda: subprocess.run(args, check=True, capture_output=True, env={"GIT_TERMINAL_PROMPT": "0", "PATH": "/usr/bin:/bin"}), on=(subprocess.CalledProcessError,))
    return to


def labelled(items: DataFrame, url: str) -> DataFrame:
    """Items of a clone, their paths below owner/name of its URL."""
    bare = url.removesuffix(".git")
    name = (bare.split("://", 1)[1].partition("/")[2] or bare.split("://", 1)[1]) if "://" in bare else bare.rpartition(":")[2]
    return items.withColumn("path", F.concat(F.lit((name or url) + "/"), F.ltrim("path", F.lit("/"))))


class _Range(InputPartition):
    def __init__(self, blobs: list[tuple[str, str]]):
        super().__init__(0)
        self.blobs = blobs


class _Reader(DataSourceReader):
    """Blobs are listed once; each partition reads a range of object ids."""

    def __init__(self, options: dict):
        self.folder, self.most, self.each = options["path"], int(options.get("most_bytes", MOST_BYTES)), int(options.get("blobs", BLOBS))
        self.exclude = [x for x in options.get("exclude", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        first: dict[str, str] = {}
        for line in _git(self.folder, "rev-list", "--objects", "--all").decode("utf-8", "replace").splitlines():
            sha, _, path = line.partition(" ")
            if path and path.rpartition(".")[2].lower() not in BINARY and not any(path_matches(x, path) for x in self.exclude):
                first.setdefault(sha, path)
        blobs = sorted(first.items())
        return [_Range(blobs[k : k + self.each]) for k in range(0, len(blobs), self.each)] or [_Range([])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.blobs:
            return
        ask = "".join(f"{sha}\n" for sha, _ in partition.blobs).encode()
        kinds = [line.split() for line in _git(self.folder, "cat-file", "--batch-check", stdin=ask).decode().splitlines()]
        fit = [b for b, k in zip(partition.blobs, kinds) if len(k) == 3 and k[1] == "blob" and 0 < int(k[2]) <= self.most]
        with subprocess.Popen(["git", "-C", self.folder, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for sha, path in fit:  # one process for the range, one blob in memory
                p.stdin.write(f"{sha}\n".encode())
                p.stdin.flush()
                size = int(p.stdout.readline().split()[2])
                content = p.stdout.read(size)
                p.stdout.read(1)
                yield sha, path, size, content
            p.stdin.close()


class GitHistory(DataSource):
    """spark.read.format("git_history").load(folder): sha, path, size and content of every blob of any commit."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "sha string, path string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def history(spark: SparkSession, folder: str, exclude=(), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Items of all blobs; meta holds the blob's id."""
    spark.dataSource.register(GitHistory)
    blobs = spark.read.format("git_history").option("exclude", ",".join(exclude)).option("most_bytes", most_bytes).load(folder)
    return blobs.select(F.xxhash64("sha").alias("item_id"), normalized(F.col("content")).alias("text"), source_of(F.col("path")).alias("source"), "path", F.create_map(F.lit("blob"), "sha").alias("meta")).where("text IS NOT NULL")
