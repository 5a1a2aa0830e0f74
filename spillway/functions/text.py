"""Places in texts, and strings' forms, as Columns (POS, PRJ, SCL)."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spillway.detect import words as W


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _text(b: Column) -> Column:
    """Text of bytes that may begin or end inside a character, which is left out."""
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), "^\ufffd+|\ufffd+$", "")


def prefix(text: Column, start: Column) -> Column:
    """The text before a byte offset, cut back to whole characters."""
    return _text(F.substring(_bytes(text), F.lit(1), start))


def line_of(text: Column, start: Column) -> Column:
    """Line of a byte offset, from 1."""
    p = prefix(text, start)
    return (F.char_length(p) - F.char_length(F.replace(p, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, start: Column) -> Column:
    """Byte in its line of a byte offset, from 1."""
    return (F.octet_length(F.substring_index(prefix(text, start), "\n", -1)) + 1).cast("int")


def column_utf16(text: Column, start: Column) -> Column:
    """UTF-16 units in its line before a byte offset, as editors count."""
    return (F.octet_length(F.encode(F.substring_index(prefix(text, start), "\n", -1), "UTF-16BE")) / 2).cast("int")


def before(text: Column, start: Column) -> Column:
    """The line before a byte offset, of PREFIX_WINDOW bytes at most, in lower case."""
    lo = F.greatest(start - W.PREFIX_WINDOW, F.lit(0))
    window = _text(F.substring(_bytes(text), lo + 1, start - lo))
    return F.lower(F.substring_index(window, "\n", -1))


def line_text(text: Column, start: Column) -> Column:
    """The line of a byte offset, its first LINE_BYTES bytes."""
    head = F.substring_index(prefix(text, start), "\n", -1)
    tail = F.substring_index(_text(F.substring(_bytes(text), start + 1, F.octet_length(text))), "\n", 1)
    return _text(F.substring(_bytes(F.concat(head, tail)), 1, W.LINE_BYTES))


def leading_name(line: Column) -> Column:
    """The first name that something is assigned to."""
    return F.regexp_extract(line, r"([A-Za-z_][A-Za-z0-9_.\-]*)[\t\n\f\r ]*[:=]", 1)


def lower_ascii(s: Column) -> Column:
    """Lower case of A to Z alone, of the same length."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_any(s: Column, words) -> Column:
    """Whether s holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(s, F.lit(w))
    return out


def redact(value: Column) -> Column:
    """Masked, but for four characters at either end; of a private key its kind and the start of its hash."""
    n = F.char_length(value)
    kind = F.regexp_extract(F.trim(value), W.PEM_HEAD, 1)
    short = F.repeat(F.lit("*"), n)
    long = F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), F.least(F.lit(8), n - 8)), F.right(value, F.lit(4)))
    key = F.concat(F.trim(kind), F.lit(" [sha256:"), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))
    return F.when(kind != "", key).when(n <= 8, short).otherwise(long)


def fingerprint(kind: Column, path: Column, value: Column) -> Column:
    """Identity of a finding that outlives its moving in the file; null without a value."""
    return F.when(value != "", F.sha2(F.concat(F.coalesce(kind, F.lit("")), F.lit("\0"), F.coalesce(path, F.lit("")), F.lit("\0"), value), 256))


def legacy_key(kind: Column, path: Column, line: Column, redacted: Column) -> Column:
    """The key of a finding without fingerprint."""
    return F.sha1(F.concat_ws("|", F.coalesce(kind, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(line, F.lit(0)).cast("string"), F.coalesce(redacted, F.lit(""))))


def strip_control(s: Column) -> Column:
    """Without escape sequences and control characters."""
    return F.regexp_replace(F.regexp_replace(s, "\\x1b\\[[0-9;?]*[A-Za-z]", ""), "[\\x00-\\x08\\x0b-\\x1f\\x7f\\x80-\\x9f]", "")


def word_list(s: Column) -> Column:
    """Parts between commas, trimmed, in lower case, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def sanitize(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))


def decode_xml(s: Column) -> Column:
    """The five entities of XML, in one pass: what an entity gives isn't decoded again."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def unescape(s: str) -> str:
    """HTML entities, then the escapes of JSON and JavaScript."""
    s = html.unescape(s).replace("\\/", "/").replace('\\"', '"')
    s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@F.arrow_udf(StringType())
def decode_escapes(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unescape(x) for x in s.to_pylist()], pa.string())


def url_host(s: Column) -> Column:
    """Host of a URL in lower case, without user, port and brackets; empty without ://."""
    rest = F.when(F.contains(s, F.lit("://")), F.substring_index(F.regexp_replace(s, r"^(?s).*?://", ""), "/", 1)).otherwise(F.lit(""))
    authority = F.substring_index(rest, "@", -1)
    return lower_ascii(F.when(F.startswith(authority, F.lit("[")), F.regexp_extract(authority, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(authority, ":", 1)))


LOCAL_HOSTS = ("localhost", "::1", "127.0.0.1", "[::1]", "0.0.0.0")
SERVICE_HOSTS = ("database", "db", "host.docker.internal", "memcached", "mongo", "mongodb", "mysql", "postgres", "postgresql", "rabbitmq", "redis")


def is_local_host(host: Column) -> Column:
    return host.isin(*LOCAL_HOSTS, *SERVICE_HOSTS) | host.rlike(r"^(?:10\.|192\.168\.|169\.254\.|172\.0*(?:1[6-9]|2[0-9]|3[01])(?:\.|\z))")


def redact_url(s: Column) -> Column:
    """A URL without user and query."""
    return F.regexp_replace(F.regexp_replace(s, r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]*@", "$1***@"), r"\?[^#\s]*", "?***")


def normal_domain(s: Column) -> Column:
    """Host name of what a user typed as a target."""
    bare = F.regexp_replace(F.lower(F.trim(s)), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.rtrim(F.regexp_replace(bare, r"[/:?#].*$", ""), F.lit("."))


def source_maps(url: Column) -> Column:
    """Where the source map of a script may be."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(F.lower(bare).rlike(r"\.(?:js|mjs|cjs|css)\z"), F.array(F.concat(bare, F.lit(".map")))).otherwise(F.expr("cast(array() as array<string>)"))


def sev_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).when(severity == "info", 0).otherwise(-1)


def clamp(c: Column) -> Column:
    """A confidence that is finite and within 0 and 1."""
    return F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(0.0)).when(c > 1, F.lit(1.0)).otherwise(c)


def confidence_tag(c: Column, stage: Column) -> Column:
    return F.when(F.contains(stage, F.lit("checksum")), "proven").when(c >= 0.9, "high").when(c >= 0.6, "medium").otherwise("low")


def parse_size(s: str) -> int:
    """Bytes of a size such as 10M, base 1024."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMG]?)(?:i?B)?\s*", s, re.I)
    if m is None:
        raise ValueError(f"not a size: {s!r}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} replaced, and {{base64(EXPR)}}, within which the bare words are replaced first."""
    out = template
    inner = F.regexp_extract(template, r"\{\{base64\((.*?)\)\}\}", 1)
    for name, c in values.items():
        inner = F.replace(inner, F.lit(name), c)
    coded = F.base64(F.encode(inner, "UTF-8"))
    out = F.when(F.contains(template, F.lit("{{base64(")), F.replace(template, F.regexp_extract(template, r"\{\{base64\(.*?\)\}\}", 0), coded)).otherwise(out)
    for name, c in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), c)
    return out
