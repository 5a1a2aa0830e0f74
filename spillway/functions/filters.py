"""Tests of a value, as Columns (FLT-12 to FLT-26, SCL-08 to SCL-15).  A null value passes none: each gives false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spillway.detect import words as W
from spillway.detect.model import BASE62
from spillway.functions.entropy import shannon_char
from spillway.functions.text import has_any


def _no_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _java(rx: str) -> str:
    return rx.replace(r"\Z", r"\z")


def is_template_ref(v: Column) -> Column:
    return _no_null(v.rlike(_java(W.TEMPLATE_REF)))


def sequence_dominates(v: Column) -> Column:
    runs = F.regexp_extract_all(v, F.lit(f"({W.SEQUENCE})"), F.lit(1))
    covered = F.aggregate(runs, F.lit(0), lambda n, x: n + F.octet_length(x))
    return _no_null((F.size(runs) > 0) & ((F.octet_length(v) <= 16) | (covered * 2 >= F.octet_length(v))))


def is_placeholder(v: Column) -> Column:
    low = F.lower(v)
    weak = has_any(low, W.WEAK_PLACEHOLDERS) & (shannon_char(v) < W.WEAK_CEILING)
    return _no_null(low.isin(*W.EXAMPLE_VALUES) | has_any(low, W.PLACEHOLDERS) | v.rlike(W.FILLER) | is_template_ref(v) | sequence_dominates(low) | weak)


def uri_credential(v: Column) -> Column:
    """The password of a URI, or null."""
    rest = F.when(F.contains(v, F.lit("//")), F.regexp_replace(v, r"^(?s).*?//", ""))
    authority = F.when(F.contains(rest, F.lit("@")), F.substring_index(rest, "@", 1))
    return F.when(F.contains(authority, F.lit(":")), F.regexp_replace(authority, r"^(?s)[^:]*:", ""))


def uri_credential_is_ref(v: Column) -> Column:
    return is_template_ref(uri_credential(v))


def is_hex(v: Column) -> Column:
    return _no_null(v.rlike(r"^[0-9a-fA-F]+\z"))


def is_digest(v: Column, before: Column) -> Column:
    n = F.octet_length(v)
    return _no_null(is_hex(v) & (n.isin(*W.DIGEST_LENGTHS) | ((n == 32) & ~has_any(F.coalesce(before, F.lit("")), W.HEX_CUES))))


def is_blob(before: Column) -> Column:
    return _no_null(has_any(before, W.BLOB_CUES))


def names_secret(before: Column) -> Column:
    return _no_null(has_any(before, W.SECRET_NAME_CUES))


def is_code_path(v: Column) -> Column:
    return _no_null(v.rlike(_java(W.CODE_PATH)))


def is_recaptcha(v: Column, before: Column) -> Column:
    return _no_null(v.rlike(_java(W.RECAPTCHA_KEY)) & has_any(before, W.RECAPTCHA_CUES))


def is_version_or_number(v: Column) -> Column:
    return _no_null(v.rlike(r"^[0-9._\-]*\z"))


def has_js_operator(v: Column) -> Column:
    return _no_null(has_any(v, W.JS_OPERATORS))


def is_unicode_escaped(v: Column) -> Column:
    n = F.regexp_count(v, F.lit(r"\\u[0-9a-fA-F]{4}"))
    return _no_null((n >= 3) & (n * 30 >= F.octet_length(v) * 4))


def looks_like_js(v: Column) -> Column:
    return _no_null(has_any(v, W.JS_WORDS) | v.rlike(_java(W.JS_MEMBER)))


def unbalanced(v: Column) -> Column:
    """Whether some kind of bracket closes before it opens, or stays open."""
    return _no_null(_open(v, "(", ")") | _open(v, "[", "]") | _open(v, "{", "}"))


def _open(v: Column, opener: str, closer: str) -> Column:
    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == opener, 1).when(c == closer, -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(a["least"], depth).alias("least"))

    only = F.split(F.regexp_replace(v, f"[^\\{opener}\\{closer}]", ""), "")
    walk = F.aggregate(only, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), step)
    return (walk["depth"] != 0) | (walk["least"] < 0)


def looks_like_identifier(v: Column) -> Column:
    return _no_null(v.rlike(r"^[$@]") | F.contains(v, F.lit("/")) | v.rlike(W.CALL) | v.rlike(_java(W.SNAKE_WORD)) | v.rlike(_java(W.CAMEL_WORD)) | unbalanced(v))


def looks_like_password(v: Column) -> Column:
    return _no_null(v.rlike(r"[^a-z]"))


def is_license_key(v: Column) -> Column:
    return _no_null(v.rlike(_java(W.LICENSE_KEY)))


def is_regex_authority(v: Column) -> Column:
    return _no_null(has_any(v, ("(?", "[^")))


def looks_random(s: Column) -> Column:
    up, low, digit = s.rlike("[A-Z]"), s.rlike("[a-z]"), s.rlike("[0-9]")
    return (up & low) | ((F.octet_length(s) >= 16) & (up | low) & digit)


def has_ramp_tail(v: Column) -> Column:
    shape = (F.octet_length(v) <= 16) | v.rlike(W.INNER_SIGN)
    return _no_null(F.lower(v).rlike(_java(W.RAMP_TAIL)) & shape & ~F.exists(F.split(v, "[^A-Za-z0-9]+"), looks_random))


def is_placeholder_key(v: Column) -> Column:
    token = F.arrays_overlap(F.split(F.lower(v), "[^A-Za-z0-9]+"), F.array(*map(F.lit, W.PLACEHOLDER_TOKENS)))
    return _no_null(is_placeholder(v) | v.rlike(r"(?:HERE|YOUR)\z") | token | has_ramp_tail(v))


def is_password_token(v: Column) -> Column:
    lo, hi = W.TOKEN_BYTES
    shape = F.octet_length(v).between(lo, hi) & v.rlike("[a-z]") & v.rlike("[0-9]") & ~v.rlike(r"[/:\\]")
    return _no_null(shape & ~is_placeholder(v) & ~is_version_or_number(v) & ~is_hex(v))


def base64_url(segment: Column) -> Column:
    """Bytes of unpadded URL-safe base64, or null."""
    ok = segment.rlike(r"^[A-Za-z0-9_\-]*\z") & (F.char_length(segment) % 4 != 1)
    return F.when(ok, F.try_to_binary(F.translate(segment, "-_", "+/"), F.lit("base64")))


def base64_any(v: Column) -> Column:
    """Bytes of base64 of either alphabet, padded or not, or null."""
    s = F.regexp_replace(v, "[\r\n]", "")
    body = F.regexp_replace(s, "=+$", "")
    pad = F.char_length(s) - F.char_length(body)
    ok = (F.char_length(body) % 4 != 1) & (pad <= 2) & ((pad == 0) | (F.char_length(s) % 4 == 0)) & (body.rlike(r"^[A-Za-z0-9+/]*\z") | body.rlike(r"^[A-Za-z0-9_\-]*\z"))
    return F.when(ok, F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64")))


def is_printable(b: Column) -> Column:
    """Whether more than PRINTABLE of the bytes are printable ASCII, and none is 0."""
    s = F.decode(b, "ISO-8859-1")
    n = F.char_length(s)
    good = n - F.char_length(F.regexp_replace(s, r"[\x20-\x7e\t\n\r]", ""))
    return _no_null((n > 0) & ~F.contains(s, F.lit("\0")) & (good / n > W.PRINTABLE))


def jwt_structure_ok(v: Column) -> Column:
    parts = F.split(v, r"\.")
    head = F.decode(base64_url(F.get(parts, 0)), "ISO-8859-1")
    return _no_null(F.startswith(v, F.lit("eyJ")) & (F.size(parts) == 3) & F.contains(head, F.lit('"alg"')))


def _claim_is_example(c: Column) -> Column:
    c = F.lower(F.trim(c))
    return has_any(c, ("john doe", "jane doe", "test@", "foo@bar", "@example.com", "@example.net", "@example.org")) | c.rlike(r"^(?:example\z|example )| example\z")


def is_example_jwt(v: Column) -> Column:
    parts = F.split(v, r"\.")
    payload = F.decode(base64_url(F.rtrim(F.get(parts, 1), F.lit("="))), "ISO-8859-1")
    claims = [F.get_json_object(payload, f"$.{k}") for k in ("sub", "name", "email")]
    shown = F.coalesce((claims[0] == "1234567890") & (claims[1] == "John Doe"), F.lit(False))
    for c in claims:
        shown = shown | F.coalesce(_claim_is_example(c), F.lit(False))
    return _no_null((F.size(parts) == 3) & ((F.get(parts, 2) == "") | F.get(parts, 2).isin(*W.DEMO_SIGNATURES) | shown))


def base62_crc32(body: Column) -> Column:
    """The CRC32 of a string as six digits of base 62."""
    crc = F.crc32(F.encode(body, "UTF-8"))
    return F.concat(*(F.substring(F.lit(BASE62), (F.pmod(F.floor(crc / F.lit(62**k)), F.lit(62)) + 1).cast("int"), F.lit(1)) for k in range(5, -1, -1)))


def github_checksum_ok(v: Column) -> Column:
    rest = F.regexp_extract(v, _java(W.GITHUB), 1)
    n = F.char_length(rest)
    return _no_null((n >= 7) & (base62_crc32(F.substring(rest, F.lit(1), n - 6)) == F.right(rest, F.lit(6))))


def checksum(kind: Column, v: Column) -> Column:
    """Whether the check of the type holds; null for a type without one."""
    return F.when(kind.isin("github_pat_classic", "github_token_oauth"), github_checksum_ok(v)).when(kind == "jwt", jwt_structure_ok(v))


def has_digits_colon(text: Column) -> Column:
    return _no_null(text.rlike("[0-9]{8,}:"))


def has_dotted_token(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_.\-]{50,})"), F.lit(1))
    return _no_null(F.exists(tokens, lambda t: F.char_length(t) - F.char_length(F.replace(t, F.lit("."), F.lit(""))) >= 2))


def severity_for(category: Column, confidence: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in W.CATEGORY_SEVERITY.items() for x in kv))
    s = F.coalesce(F.try_element_at(table, category), F.lit("medium"))
    return F.when((s == "critical") & (confidence < 0.7), "high").otherwise(s)


def demote(severity: Column) -> Column:
    return F.when(severity == "critical", "high").when(severity == "high", "medium").otherwise("low")


def file_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^(?s)(?:(?!\|layer)(?!\|image:).)*\|(?:layer[^:]*|image):", "")


def is_file_source(source: Column) -> Column:
    return F.coalesce(source, F.lit("")).isin(*W.FILE_SOURCES)


def is_example_path(path: Column) -> Column:
    p = F.lower(path)
    ends = F.lit(False)
    for s in W.EXAMPLE_SUFFIXES:
        ends = ends | F.endswith(p, F.lit(s))
    segment = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, W.EXAMPLE_SEGMENTS)))
    return _no_null(ends | segment | has_any(F.substring_index(p, "/", -1), W.EXAMPLE_HINTS))


def is_lockfile(path: Column) -> Column:
    return _no_null(F.regexp_replace(path, r"^(?s).*[/\\]", "").isin(*W.LOCKFILES))


def adjusted_severity(severity: Column, kind: Column, stage: Column, low_evidence: Column) -> Column:
    """Demoted in comments and example paths; a proven checksum never, a generic type to low."""
    return F.when((stage == "L1-checksum") | ~low_evidence, severity).when(kind.isin(*W.GENERIC_LAST), "low").otherwise(demote(severity))


def matches_path(path: Column, pattern: str) -> Column:
    from spillway.detect.dialect import path_regex

    rx = path_regex(pattern)
    return _no_null(F.contains(path, F.lit(pattern)) if rx is None else path.rlike(_java(rx)))
