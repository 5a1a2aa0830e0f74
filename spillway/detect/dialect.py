"""Patterns of the linear-time dialect that rules are written in, for Python's and Java's engines."""

from __future__ import annotations

import re
from re import _parser

MOST_BYTES, MOST_BOUND, MOST_TOTAL = 4096, 1000, 10_000
_WORD = "0-9A-Za-z_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_NOT_BOUNDARY = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_CLASSES = {"d": "0-9", "w": _WORD, "s": r"\t\n\f\r "}
_NOT = {"D": "0-9", "W": _WORD, "S": r"\t\n\f\r "}
_BOUND = re.compile(r"\{(\d*)(?:,(\d*))?\}")


def is_safe(pattern: str) -> bool:
    """Whether a pattern is short, its bounds are small, it compiles, and no quantified group holds a quantifier without bound."""
    if len(pattern.encode()) > MOST_BYTES:
        return False
    bounds = [max(int(a or 0), int(b or 0)) for a, b in _BOUND.findall(pattern)]
    if any(b > MOST_BOUND for b in bounds) or sum(bounds) > MOST_TOTAL:
        return False
    try:
        compiled(pattern)
    except (re.error, OverflowError, ValueError):
        return False
    return True


def backtracks(pattern: str) -> bool:
    """Whether a repeated group repeats something without bound inside, which a backtracking engine may take long for."""
    stack, i, loose = [], 0, False
    unbounded = []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            j += pattern[j : j + 1] == "]"
            while j < len(pattern) and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            i = j + 1
            continue
        if c == "(":
            stack.append(len(unbounded))
        elif c == ")" and stack:
            at = stack.pop()
            rest = pattern[i + 1 : i + 2]
            inner = len(unbounded) > at
            if rest in ("*", "+") or re.match(r"\{\d*,\}", pattern[i + 1 :]):
                loose |= inner
                unbounded.append(i)
        elif c in "*+" or re.match(r"\{\d*,\}", pattern[i:]):
            unbounded.append(i)
        i += 1
    return loose


def translate(pattern: str, java: bool = False) -> str:
    """The pattern with word boundaries, classes, ends and dots as the linear-time engine has them."""
    out, i, inside = [], 0, False
    multiline = bool(re.match(r"\(\?[a-z]*m", pattern))
    flags = ""
    head = re.match(r"\(\?([imsU]+)\)", pattern)
    if head:  # flags of the whole pattern
        flags, pattern = head[1].replace("U", ""), pattern[head.end() :]
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\" and len(two) == 2:
            e = two[1]
            if e in _CLASSES:
                out.append(_CLASSES[e] if inside else f"[{_CLASSES[e]}]")
            elif e in _NOT and not inside:
                out.append(f"[^{_NOT[e]}]")
            elif e == "b" and not inside:
                out.append(_BOUNDARY)
            elif e == "B" and not inside:
                out.append(_NOT_BOUNDARY)
            elif e == "z":
                out.append(r"\z" if java else r"\Z")
            else:
                out.append(two)
            i += 2
            continue
        if inside:
            posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if posix:
                out.append({"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "space": r"\t\n\v\f\r ", "xdigit": "0-9A-Fa-f", "word": _WORD}.get(posix[2], ""))
                i += posix.end()
                continue
            inside = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "$" and not multiline and "m" not in flags:
            out.append(r"\z" if java else r"\Z")
        elif c == "(" and pattern.startswith("(?P<", i):
            end = pattern.index(">", i)
            out.append("(")
            i = end
        else:
            out.append(c)
        i += 1
    body = "".join(out)
    if java:
        return f"(?{flags.replace('i', 'iu')}d)" + body
    return (f"(?{flags})" if flags else "") + body


def compiled(pattern: str) -> re.Pattern:
    return re.compile(translate(pattern))


def compiled_bytes(pattern: str) -> re.Pattern:
    """For UTF-8 bytes: offsets are bytes, and classes are ASCII."""
    return re.compile(translate(pattern).encode())


def required(pattern: str | bytes) -> tuple[bytes, ...]:
    """Literals of which every match holds at least one; empty if none can be told.  Sound: it only looks at what can't be skipped."""
    source = pattern.decode() if isinstance(pattern, bytes) else translate(pattern)
    tree = _parser.parse(source.encode())
    return _best(tree) if not tree.state.flags & re.IGNORECASE else ()


def _best(tree) -> tuple[bytes, ...]:
    found: list[tuple[bytes, ...]] = []
    run = bytearray()

    def cut():
        if run:
            found.append((bytes(run),))
            run.clear()

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run.append(arg)
            continue
        if name == "SUBPATTERN" and not arg[1] and not arg[2] and all(str(o) == "LITERAL" for o, _ in arg[3]):
            run.extend(a for _, a in arg[3])
            continue
        cut()
        if name == "SUBPATTERN" and not arg[1] & re.IGNORECASE:
            found.append(_best(arg[3]))
        elif name == "BRANCH":
            each = [_best(t) for t in arg[1]]
            if all(each):
                found.append(tuple(sorted({x for e in each for x in e})))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found.append(_best(arg[2]))
    cut()
    found = [f for f in found if f]
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=())


MOST_HEADS = 64


def heads(pattern: str | bytes) -> tuple[tuple[bytes, int], ...]:
    """(literal, shift): every match starts `shift` bytes after the start of such a literal in the text's lower case; empty if that can't be told.

    Places where no match starts may be among them, so a match is still tried at each.
    """
    tree = _parser.parse(pattern if isinstance(pattern, bytes) else translate(pattern).encode())
    if tree.getwidth()[0] == 0:
        return ()
    found = _heads(list(tree))
    return tuple(sorted(found)) if found and all(len(lit) > 1 for lit, _ in found) else ()


def _heads(items: list) -> set[tuple[bytes, int]] | None:
    """What a sequence starts with: literals in lower case, each as long as can be told."""
    if items and str(items[0][0]) == "ASSERT" and items[0][1][0] < 0:
        behind = _starts(list(items[0][1][1]))
        if behind is not None and len(behind) == 1 and all(str(op) == "LITERAL" for op, _ in items[0][1][1]):
            return {(x, len(x)) for x in behind}
    if len(items) == 1 and str(items[0][0]) == "BRANCH":
        each = [_heads(list(t)) for t in items[0][1][1]]
        return None if any(e is None for e in each) else {x for e in each for x in e}
    if len(items) > 1 and str(items[0][0]) == "BRANCH" and _starts(items) is None:
        widths = [t.getwidth() for t in items[0][1][1]]
        if max(hi for _, hi in widths) == 1:  # the start of the text, or a byte before
            rest = _starts(items[1:])
            return None if rest is None else {(x, -k) for x in rest for k in range(min(lo for lo, _ in widths), 2)}
    out = _starts(items)
    return None if out is None else {(x, 0) for x in out}


def _starts(items: list) -> set[bytes] | None:
    out, done = _prefixes(items)
    return None if b"" in out or len(out) > MOST_HEADS else {bytes(x) for x in out}


def _prefixes(items: list) -> tuple[set[bytes], bool]:
    """Prefixes of all that a sequence matches, and whether each is a whole match of it."""
    out = {b""}
    for op, arg in items:
        name = str(op)
        if name in ("ASSERT", "ASSERT_NOT", "AT"):  # no width
            continue
        if name == "LITERAL":
            more, whole = {bytes((arg,)).lower()}, True
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more, whole = {bytes((a,)).lower() for _, a in arg}, True
        elif name == "SUBPATTERN":
            more, whole = _prefixes(list(arg[3]))
        elif name == "BRANCH":
            each = [_prefixes(list(t)) for t in arg[1]]
            more, whole = {x for e, _ in each for x in e}, all(w for _, w in each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            more, whole = _prefixes(list(arg[2]))[0], False
        else:
            return out, False
        if len(out) * len(more) > MOST_HEADS:
            return out, False
        out = {a + b for a in out for b in more}
        if not whole:
            return out, False
    return out, True


def search(rx: re.Pattern, at: tuple[tuple[bytes, int], ...], text: bytes, low: bytes):
    """rx.finditer(text), tried only where its heads() are; low is the text in lower case."""
    if not at:
        yield from rx.finditer(text)
        return
    places = []
    for lit, shift in at:
        k = low.find(lit)
        while k >= 0:
            places.append(k + shift)
            k = low.find(lit, k + 1)
    if not places:
        return
    places.sort()
    end, match = 0, rx.match  # none starts before the text
    for k in places:
        if k >= end and (m := match(text, k)) is not None:
            yield m
            end = m.end()


def glob(pattern: str) -> str:
    """An anchored regex of a path glob: * and ? stay within a segment, ** crosses them."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = end
        else:
            out.append(re.escape(c) if c not in "/" else c)
        i += 1
    return "^" + "".join(out) + r"\Z"


def path_regex(pattern: str) -> str | None:
    """The regex of a path pattern, or None for one without glob characters, which is a substring."""
    if not re.search(r"[*?\[]", pattern):
        return None
    rx = glob(pattern)
    return rx if pattern.startswith("/") else "^(?:.*/)?" + rx[1:]


def path_matches(pattern: str, path: str) -> bool:
    rx = path_regex(pattern)
    return pattern in path if rx is None else re.match(rx, path, re.S) is not None
