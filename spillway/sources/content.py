"""From bytes to text: binary tests, character sets, printable strings (SRC-05, SRC-06, SRC-07, SRC-17)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAGIC = (b"%PDF-", b"%!PS", b"\xff\xd8\xff")
SNIFF = 8000
RUN, CLIP = 5, 4096
_ASCII = re.compile(rb"[\t\x20-\x7e]{%d,}" % RUN)
_WIDE = re.compile(rb"(?:[\t\x20-\x7e]\x00){%d,}" % RUN)


def looks_binary(b: bytes) -> bool:
    return b.startswith(MAGIC) or b"\0" in b[:SNIFF]


def is_binary(content: Column) -> Column:
    """The same, natively."""
    head = F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1")
    magic = F.lit(False)
    for m in MAGIC:
        magic = magic | F.startswith(head, F.lit(m.decode("latin-1")))
    return F.coalesce(magic | F.contains(head, F.lit("\0")), F.lit(False))


def _wide_order(b: bytes) -> str | None:
    """UTF-16 without a mark: NULs in a quarter of the units at least, all on one side."""
    head = b[:SNIFF]
    even, odd = head[0::2].count(0), head[1::2].count(0)
    units = len(head) // 2
    if units < 2 or 4 * (even + odd) < units or (even and odd):
        return None
    return "utf-16-le" if odd else "utf-16-be"


def text_of(b: bytes | None) -> str | None:
    """The text of a file, or None for a binary one."""
    if not b:
        return None
    for mark, code in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if b.startswith(mark):
            return b[len(mark) :].decode(code, "replace")
    if b.startswith(b"\xef\xbb\xbf"):
        b = b[3:]
    if b.startswith(MAGIC):
        return None
    if b"\0" in b[:SNIFF]:
        code = _wide_order(b)
        return b.decode(code, "replace") if code else None
    return b.decode("utf-8", "replace")


def printable(b: bytes) -> str:
    """Printable runs: of bytes, then of UTF-16LE units at both alignments, a line each."""
    rows = [m[0][:CLIP] for m in _ASCII.finditer(b)]
    for shift in (0, 1):
        rows += [m[0].replace(b"\0", b"")[:CLIP] for m in _WIDE.finditer(b, shift) if (m.start() - shift) % 2 == 0]
    return b"\n".join(rows).decode("ascii")


SLICE_BYTES = 1 << 20


def by_slices(f, content: pa.Array, *others: pa.Array) -> pa.Array:
    """f of each value, with about SLICE_BYTES of them as Python objects at a time."""
    out, rows, held = [], [], 0
    for x in zip(content, *others):
        rows.append(f(*(v.as_py() for v in x)))
        held += len(rows[-1] or "")
        if held > SLICE_BYTES:
            out.append(pa.array(rows, pa.string()))
            rows, held = [], 0
    out.append(pa.array(rows, pa.string()))
    return pa.concat_arrays(out)


@F.arrow_udf(StringType())
def normalized(content: pa.Array) -> pa.Array:
    """Text of a file's bytes in any of the known sets; null for binary, empty and null contents."""
    return by_slices(text_of, content)


@F.arrow_udf(StringType())
def strings(content: pa.Array) -> pa.Array:
    return by_slices(lambda x: None if x is None else printable(x), content)


def source_of(path: Column) -> Column:
    """file for documents, code for all else."""
    return F.when(F.lower(path).rlike(r"\.(?:adoc|md|rst|txt)\z"), "file").otherwise("code")
