"""Installing a rule set: checked, compared with what is there, then mirrored (SRC-30, JN-15, JN-16)."""

from __future__ import annotations

import hashlib
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.rules import template


def read(folder: str) -> dict[str, bytes]:
    """Rule files below a folder by relative path.  A link, to a file or of a folder, rejects the set."""
    root, out = Path(folder), {}
    for at, folders, names in os.walk(root):
        for n in [*folders, *names]:
            if (Path(at) / n).is_symlink():
                raise ValueError(f"a link in a rule set: {Path(at) / n}")
        for n in names:
            if n.endswith((".yaml", ".yml")):
                p = Path(at) / n
                out[str(p.relative_to(root))] = p.read_bytes()
    return out


def table(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(p, hashlib.sha256(b).hexdigest()) for p, b in sorted(files.items())], "path string, hash string")


def diff(old: DataFrame, new: DataFrame, key: str = "path", hash: str = "hash") -> DataFrame:
    """key and change of every file in either set: added, removed, changed or same."""
    rows = old.select(key, F.col(hash).alias("__old")).join(new.select(key, F.col(hash).alias("__new")), key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    return rows.select(key, change.alias("change"))


def check(files: dict[str, bytes], manifest: str | None = None) -> list[str]:
    """What is wrong with a set: a manifest that differs, files that can't be read, rules with faults, ids twice."""
    out = template.verify_manifest(files, manifest) if manifest is not None else []
    rules = []
    for p, b in sorted(files.items()):
        try:
            rules += template.loads(b.decode(), p)
        except (ValueError, UnicodeDecodeError, KeyError, TypeError, AttributeError) as e:
            out.append(f"{p}: {e}")
    out += [f"{t.id or t.path}: {x}" for t in rules for x in template.lint(t)]
    return out + [f"{i}: id twice" for i in template.duplicates(rules)]


def install(spark: SparkSession, source: str, target: str, manifest: str | None = None) -> list[tuple[str, str]]:
    """Makes target what source is, if source is sound; the changes, in order of path."""
    new = read(source)
    faults = check(new, manifest)
    if faults or not new:
        raise ValueError("; ".join(faults[:5]) or "an empty rule set")
    old = read(target) if os.path.isdir(target) else {}
    changes = sorted((r.path, r.change) for r in diff(table(spark, old), table(spark, new)).collect() if r.change != "same")
    fresh = Path(target + ".new")
    shutil.rmtree(fresh, ignore_errors=True)
    for p, b in new.items():
        (fresh / p).parent.mkdir(parents=True, exist_ok=True)
        (fresh / p).write_bytes(b)
    shutil.rmtree(target, ignore_errors=True)
    fresh.rename(target)
    return changes
