"""The scan of a table of items (DET-01 to DET-10).

One narrow pass: an Arrow kernel reads each text once and gives its few findings; redaction,
fingerprint and the rest are Columns over these.  Nothing is shuffled, so a scan of any size
is as fast as its slowest executor reads.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.detect import table
from spillway.detect.kernel import Allow, Finding, Scanner
from spillway.functions import text as T
from spillway.schema import RAW

_ARROW = pa.struct([
    ("detector", pa.string()), ("type", pa.string()), ("category", pa.string()), ("confidence", pa.float64()), ("severity", pa.string()), ("line", pa.int32()), ("col", pa.int32()),
    ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("stage", pa.string()), ("name", pa.string()), ("text", pa.string()), ("rationale", pa.string()),
])


#: Items that are Python objects at a time.
SLICE = 256
#: The type of the row that stands for an item whose scan failed; its rationale says why.
FAILED = "scan_failed"


@lru_cache(16)
def _scanner(detectors, templates, allow, cap) -> Scanner:
    """One for each process and set of rules, so patterns are compiled once."""
    return Scanner(detectors, templates, allow, cap)


def found(text: Column, path: Column, source: Column, detectors=table.BUILTIN, templates=(), allow: Allow = Allow(), cap: int | None = None) -> Column:
    """Findings of a text as an array of structs; null for a null text.  An item whose scan fails has one row, of type FAILED."""
    key = (tuple(detectors), tuple(templates), allow, cap or Scanner().cap)

    def some(text: pa.Array, path: list, source: list) -> pa.Array:
        scanner = _scanner(*key)
        out = []
        for t, p, s in zip(text, path, source):
            t = t.as_py()
            try:
                hits = None if t is None else scanner.scan(t, p, s)
            except Exception as e:  # one bad item is a finding of its own, and takes no other with it
                hits = [Finding(FAILED, "", 0.0, "info", 0, 0, 0, 0, "", "intake", rationale=f"{type(e).__name__}: {e}"[:200])]
            out.append(hits)
        flat = [f for hits in out if hits for f in hits]
        names = [n for n in _ARROW.names if n != "detector"]
        fields = [pa.array(["scan" if f.stage == "intake" else f.type for f in flat], pa.string()), *(pa.array([getattr(f, n) for f in flat], _ARROW.field(n).type) for n in names)]
        size = np.array([len(hits) if hits else 0 for hits in out], np.int32)
        off = pa.array(np.r_[np.int32(0), np.cumsum(size, dtype=np.int32)], mask=np.r_[[hits is None for hits in out], False] if out else None)
        return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(fields, _ARROW.names))

    @F.arrow_udf(f"array<{RAW}>")
    def run(text: pa.Array, path: pa.Array, source: pa.Array) -> pa.Array:
        # Findings are Python objects only of so many items at a time.
        parts = [some(text[k : k + SLICE], path[k : k + SLICE].to_pylist(), source[k : k + SLICE].to_pylist()) for k in range(0, len(text), SLICE)]
        return pa.concat_arrays(parts) if parts else some(text, [], [])

    return run(text, path, source)


def raw(items: DataFrame, detectors=table.BUILTIN, templates=(), allow: Allow = Allow(), cap: int | None = None) -> DataFrame:
    """item_id, source, path, meta and the fields of each finding, its raw value too: for operators, never for output.

    Other columns of the items aren't carried.  Items of null text have no findings; null path and source count as empty.
    """
    kept = items.select("item_id", "text", "source", "path", "meta")
    hits = kept.select("item_id", "source", "path", "meta", F.explode(found(F.col("text"), F.col("path"), F.col("source"), detectors, templates, allow, cap)).alias("f"))
    return hits.select("item_id", "source", "path", "meta", "f.*")


def findings(items: DataFrame, detectors=table.BUILTIN, templates=(), allow: Allow = Allow(), cap: int | None = None, show: bool = False) -> DataFrame:
    """The findings of items.  Values are masked unless `show`, which also carries their lines."""
    return finish(raw(items, detectors, templates, allow, cap), show)


def finish(hits: DataFrame, show: bool = False) -> DataFrame:
    """Output records of raw() rows."""
    meta = lambda k: F.try_element_at(F.col("meta"), F.lit(k))
    context = F.struct("name", F.col("text").alias("line")) if show else F.lit(None).cast("struct<name:string,line:string>")
    return hits.select(
        "item_id", "detector", "type", T.clamp(F.col("confidence")).alias("confidence"), "severity", "source", "path", "line", "col",
        (F.col("value") if show else T.redact(F.col("value"))).alias("redacted"), "stage", meta("url").alias("url"), F.lit(None).cast("boolean").alias("verified"), "rationale",
        T.fingerprint(F.col("type"), F.col("path"), F.col("value")).alias("fingerprint"), context.alias("context"), F.lit(None).cast("boolean").alias("in_final_image"), meta("instruction").alias("instruction"),
    )


def items(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str | None = None, path: Column | None = None) -> DataFrame:
    """A table of items from any table with an id and a text."""
    of = F.coalesce(F.lit(source), F.lit("file")) if source is not None or "source" not in docs.columns else F.col("source")
    return docs.select(
        F.col(id).cast("long").alias("item_id"), F.col(text).alias("text"), of.alias("source"), (path if path is not None else F.concat_ws("/", of, F.col(id).cast("string"))).alias("path"),
        F.lit(None).cast("map<string,string>").alias("meta"),
    )
