"""Entropies and other figures of a string's symbols, as Columns (SCL-01 to SCL-07)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BASE64, HEX = "A-Za-z0-9+/=_-", "0-9A-Fa-f"


def symbols(s: Column) -> Column:
    return F.array_distinct(F.split(s, ""))


def _spread(units: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Entropy of each stretch of units, from the counts of different units: one sort, no loop over symbols or rows."""
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    key = np.sort(row.astype(np.int64) << 21 | units)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count, of = np.diff(np.r_[new, len(key)]), key[new] >> 21
    p = count / size[of]
    return np.bincount(of, -p * np.log2(p), len(size)) + 0.0  # no minus zero


def _units(s: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points or bytes of all strings end to end, and each string's offsets in them; a null is empty."""
    col = pc.fill_null(s.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    units = np.frombuffer(data, np.uint8)[off[0] : off[-1]].astype(np.int64) if data is not None else np.zeros(0, np.int64)
    off = off - off[0]
    if unit == "char":
        starts = (units & 0xC0) != 0x80
        off = np.r_[0, np.cumsum(starts)][off]
        if not starts.all():
            lead = np.flatnonzero(starts)
            long = np.diff(np.r_[lead, len(units)])
            point = np.where(long == 1, units[lead], units[lead] & (0x7F >> long))
            for k in range(1, int(long.max())):
                more = long > k
                point[more] = point[more] << 6 | units[lead[more] + k] & 0x3F
            units = point
    return units, off


def _parts(s: pa.Array, most: int) -> Iterator[slice]:
    """Runs of strings of about `most` bytes; a longer one is alone."""
    upto, lo = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(s), 0), np.int64)), 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def _entropies(s: pa.Array, unit: str) -> pa.Array:
    """Entropy of code points or bytes of each string, a few million units at a time."""
    out = np.zeros(len(s))
    for part in _parts(s, 1 << 22):
        out[part] = _spread(*_units(s[part], unit))
    return pa.array(out, pa.float64(), mask=np.asarray(pc.is_null(s)))


PROFILE = ("shannon", "normalized", "base64", "hex", "bigram", "diversity")


def profiles(s: pa.Array) -> np.ndarray:
    """All of PROFILE of each string, a column each, in one pass over its code points; zeros for an empty or null string.

    Each different string is worked out once.
    """
    code = pc.fill_null(s, "").dictionary_encode()
    values = code.dictionary
    out, plain = np.zeros((len(values), len(PROFILE))), np.asarray(pc.string_is_ascii(values))
    for kind, of in ((plain, _ascii_profiles), (~plain, _any_profiles)):
        if kind.any():
            out[kind] = of(values.filter(pa.array(kind)))
    return out[np.asarray(code.indices)]


def _ascii_profiles(s: pa.Array) -> np.ndarray:
    """profiles() by counts in a table of 128 symbols for each string; only pairs are sorted.  The terms and their order are those of _spread()."""
    out = np.zeros((len(s), len(PROFILE)))

    def bits(row, count, rows) -> np.ndarray:
        p = count / np.bincount(row, count, rows)[row]
        return np.bincount(row, -p * np.log2(p), rows) + 0.0

    for part in _parts(s, 1 << 20):
        units, off = _units(s[part], "char")
        size, rows = np.diff(off), len(off) - 1
        row = np.repeat(np.arange(rows), size)
        table = np.bincount(row << 7 | units, minlength=rows << 7)
        at = np.flatnonzero(table)
        of, count, symbol = at >> 7, table[at], at & 127
        different = np.bincount(of, minlength=rows)
        whole = bits(of, count, rows)
        some = [bits(of[ok], count[ok], rows) for ok in (_IN_BASE64[symbol], _IN_HEX[symbol])]
        last = off[1:][size > 0] - 1
        table[row[last] << 7 | units[last]] -= 1  # a symbol with another after it
        at = np.flatnonzero(table)
        firsts = bits(at >> 7, table[at], rows)
        inner = np.ones(len(units), bool)
        inner[last] = False
        k = np.flatnonzero(inner)
        key = np.sort(row[k] << 14 | units[k] << 7 | units[k + 1]) if len(k) else np.zeros(0, np.int64)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        pairs = bits(key[new] >> 14, np.diff(np.r_[new, len(key)]), rows)
        following = np.where(size < 3, 0.0, np.maximum(pairs - firsts, 0.0))
        normal = np.divide(whole, np.log2(np.maximum(different, 2)), out=np.zeros(rows), where=different >= 2)
        out[part] = np.stack([whole, normal, *some, following, different / np.maximum(size, 1)], 1)
    return out


def _any_profiles(s: pa.Array) -> np.ndarray:
    """profiles() of strings of any letters, by sorts."""
    out = np.zeros((len(s), len(PROFILE)))
    for part in _parts(s, 1 << 20):
        units, off = _units(s[part], "char")
        size = np.diff(off)
        row = np.repeat(np.arange(len(size)), size)
        key = np.unique(row << 21 | units)
        different = np.bincount(key >> 21, minlength=len(size))
        whole = _spread(units, off)
        low = np.minimum(units, 127)
        some = {}
        for name, kind in (("base64", _IN_BASE64), ("hex", _IN_HEX)):
            ok = kind[low] & (units < 128)
            some[name] = _spread(units[ok], np.r_[0, np.cumsum(ok)][off])
        inner = np.ones(len(units), bool)
        inner[off[1:][size > 0] - 1] = False  # a symbol with another after it
        n = np.maximum(size - 1, 0)
        at = np.flatnonzero(inner)
        ends = np.r_[0, np.cumsum(n)]
        _, pair = np.unique(units[at] << 21 | units[np.minimum(at + 1, len(units) - 1)], return_inverse=True)
        following = np.where(size < 3, 0.0, np.maximum(_spread(pair, ends) - _spread(units[at], ends), 0.0))
        normal = np.divide(whole, np.log2(np.maximum(different, 2)), out=np.zeros(len(size)), where=different >= 2)
        out[part] = np.stack([whole, normal, some["base64"], some["hex"], following, different / np.maximum(size, 1)], 1)
    return out


_IN_BASE64, _IN_HEX = (np.array([chr(c) in kind for c in range(128)]) for kind in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", "0123456789ABCDEFabcdef"))


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in PROFILE]))
def profile(s: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c.copy()) for c in profiles(s).T], list(PROFILE))


SHAPE = ("lower", "upper", "digit", "special", "hex", "vowel", "steps", "digit_run", "alpha_run")
_letters = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = np.array([[chr(c) in kind for c in range(128)] for kind in (_letters, _letters.upper(), "0123456789", "".join(chr(c) for c in range(128) if not chr(c).isalnum()), "0123456789abcdefABCDEF", "aeiouAEIOU")])


def shapes(s: pa.Array) -> pa.StructArray:
    """Numbers of symbols of each class, of changes of case, and the longest runs of digits and letters, of ASCII strings; null for others."""
    code = pc.fill_null(s, "").dictionary_encode()
    ok = pc.string_is_ascii(code.dictionary)
    values = pc.if_else(ok, code.dictionary, "")
    out = np.zeros((len(values), len(SHAPE)))
    for part in _parts(values, 1 << 20):
        units, off = _units(values[part], "char")
        size, rows = np.diff(off), len(off) - 1
        row = np.repeat(np.arange(rows), size)
        count = lambda flags: np.bincount(row[flags], minlength=rows)  # noqa: E731, B023
        is_ = _CLASSES[:, units]
        lower, upper, digit = is_[:3]
        same = row[1:] == row[:-1]
        change = np.flatnonzero(((lower[:-1] & upper[1:]) | (upper[:-1] & lower[1:])) & same)
        runs = []
        for flags in (digit, lower | upper):
            first = np.flatnonzero(flags & np.r_[True, ~(flags[:-1] & same)][: len(flags)])
            last = np.flatnonzero(flags & np.r_[~(flags[1:] & same), True][: len(flags)])
            most = np.zeros(rows, np.int64)
            np.maximum.at(most, row[first], last - first + 1)
            runs.append(most)
        out[part] = np.stack([*map(count, is_), np.bincount(row[change], minlength=rows), *runs], 1)
    take, mask = np.asarray(code.indices), ~np.asarray(ok)
    return pa.StructArray.from_arrays([pa.array(c) for c in out[take].T.copy()], list(SHAPE), mask=pa.array(mask[take]))


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in SHAPE]))
def shape(s: pa.Array) -> pa.Array:
    return shapes(s)


@F.arrow_udf(DoubleType())
def text_entropy(s: pa.Array) -> pa.Array:
    """shannon_char() of texts of any length, in time that doesn't grow with the number of different symbols."""
    return _entropies(s, "char")


@F.arrow_udf(DoubleType())
def byte_entropy(s: pa.Array) -> pa.Array:
    """Bits a byte of the UTF-8 form of texts of any length; 0 for an empty string, null for null."""
    return _entropies(s, "byte")


def shannon_char(s: Column) -> Column:
    """Bits a code point; 0 for an empty string, null for null.  Native, for values; text_entropy() is for texts.

    A symbol is counted by what its removal takes away, one pass of native code for each
    different symbol, so no array of the whole string is kept.
    """

    def of(s: Column) -> Column:
        n = F.char_length(s).cast("double")
        p = lambda c: (n - F.char_length(F.replace(s, c, F.lit("")))) / n
        total = F.aggregate(symbols(s), F.lit(0.0), lambda h, c: F.when(c == "", h).otherwise(h - p(c) * F.log2(p(c))))
        return F.when(n == 0, F.lit(0.0)).otherwise(total)

    # A lambda's variable is worked out once; an expression in it would be for each symbol.
    return F.when(s.isNotNull(), F.get(F.transform(F.array(s), of), 0))


def latin1(s: Column) -> Column:
    """A code point for each UTF-8 byte."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def shannon_byte(s: Column) -> Column:
    """Bits a byte of the UTF-8 form; native, for values."""
    return shannon_char(latin1(s))


def normalized(s: Column) -> Column:
    """Entropy over the most that so many different symbols could have; 0 below two."""
    n = F.size(F.filter(symbols(s), lambda c: c != ""))
    return F.when(s.isNotNull(), F.when(n < 2, F.lit(0.0)).otherwise(shannon_char(s) / F.log2(n.cast("double"))))


def restricted(s: Column, alphabet: str) -> Column:
    """Entropy of the symbols that are in the alphabet."""
    return shannon_char(F.regexp_replace(s, f"[^{alphabet}]", ""))


def bigram(s: Column) -> Column:
    """Entropy of a symbol given the one before it; 0 below three symbols."""
    return F.when(s.isNotNull(), profile(s)["bigram"])


def diversity(s: Column) -> Column:
    """Different symbols over symbols; 0 for an empty string."""
    n = F.char_length(s)
    return F.when(s.isNotNull(), F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.filter(symbols(s), lambda c: c != "")) / n))


@F.arrow_udf(DoubleType())
def compression_ratio(s: pa.Array) -> pa.Array:
    """Bytes of the zlib form at level 6 over bytes; 0 for an empty string.  There is no such native function."""
    out = []
    for x in s.to_pylist():
        b = None if x is None else x.encode("utf-8", "surrogatepass")
        out.append(None if b is None else len(zlib.compress(b, 6)) / len(b) if b else 0.0)
    return pa.array(out, pa.float64())
