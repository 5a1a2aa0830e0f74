"""The part of YAML that rule files use: block and flow maps and lists, scalars, quotes, | and > text, several documents."""

from __future__ import annotations

import json
import re
from typing import Any

_INT, _FLOAT = re.compile(r"[-+]?\d+\Z"), re.compile(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?\Z")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@-][^#]*?|-[^\s#:][^#:]*?):(?:\s+|$)""")


class YamlError(ValueError):
    pass


def load_all(text: str) -> list[Any]:
    """All documents; an empty one is None."""
    docs, now = [], []
    for line in text.replace("\r\n", "\n").split("\n"):
        if re.match(r"---(\s|$)", line):
            docs.append(now)
            now = [" " * 3 + line[3:]] if line[3:].strip() and not line[3:].strip().startswith("#") else []
        elif line.startswith("%") or line.strip() == "...":
            continue
        else:
            now.append(line)
    docs.append(now)
    return [d for k, lines in enumerate(docs) if (d := _Reader(lines).document()) is not None or k]


def load(text: str) -> Any:
    return next((d for d in load_all(text) if d is not None), None)


class _Reader:
    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, 0

    def document(self) -> Any:
        out = self.block(0) if self.peek() else None
        if self.peek():
            raise YamlError(f"unread line: {self.lines[self.at]!r}")
        return out

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that isn't blank or a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.strip()
            if body and not body.startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise YamlError("tab in indentation")
                return len(line) - len(line.lstrip(" ")), body
            self.at += 1
        return None

    def block(self, least: int) -> Any:
        found = self.peek()
        if found is None or found[0] < least:
            return None
        indent, body = found
        if body == "-" or body.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(body):
            return self.mapping(indent)
        self.at += 1
        return self.scalar(self.continued(body, indent - 1), indent)

    def sequence(self, indent: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:]
            gap = len(rest) - len(rest.lstrip())
            if not rest.strip() or rest.strip().startswith("#"):
                self.at += 1
                out.append(self.block(indent + 1))
            else:
                inner = indent + 1 + gap
                self.lines[self.at] = " " * inner + rest.lstrip()
                if _KEY.match(rest.lstrip()) or rest.lstrip().startswith("- "):
                    out.append(self.block(inner))
                else:
                    body = self.peek()[1]
                    self.at += 1
                    out.append(self.value(body, indent))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict[str, Any] = {}
        while (found := self.peek()) and found[0] == indent and (m := _KEY.match(found[1])):
            key = str(self.scalar(m[1], indent))
            if key in out:
                raise YamlError(f"key twice: {key}")
            rest = found[1][m.end() :].strip()
            self.at += 1
            if not rest or rest.startswith("#"):
                nxt = self.peek()
                if nxt and (nxt[0] > indent or (nxt[0] == indent and (nxt[1] == "-" or nxt[1].startswith("- ")))):
                    out[key] = self.block(nxt[0])
                else:
                    out[key] = None
            else:
                out[key] = self.value(rest, indent)
        return out

    def value(self, body: str, indent: int) -> Any:
        if re.match(r"[|>][+-]?\d?\s*(#.*)?$", body):
            return self.text(body[0], "-" in body, "+" in body, indent)
        return self.scalar(self.continued(body, indent), indent)

    def continued(self, body: str, indent: int) -> str:
        """A quoted, flow or plain value that goes on in deeper lines."""

        def whole(s: str) -> bool:
            if s[:1] in "\"'":
                return re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(#.*)?$""", s, re.S) is not None
            if s[:1] in "[{":
                depth, quote = 0, ""
                for c in s:
                    if quote:
                        quote = "" if c == quote else quote
                    elif c in "\"'":
                        quote = c
                    else:
                        depth += (c in "[{") - (c in "]}")
                return depth <= 0 and not quote
            return True

        while self.at < len(self.lines):
            line = self.lines[self.at]
            deeper = line.strip() and len(line) - len(line.lstrip()) > indent
            if whole(body) and (body[:1] in "\"'[{" or not deeper or line.strip().startswith("#")):
                break
            if not line.strip() and whole(body):
                break
            body += " " + line.strip()
            self.at += 1
        if not whole(body):
            raise YamlError(f"open value: {body[:40]!r}")
        return body

    def text(self, style: str, strip: bool, keep: bool, indent: int) -> str:
        rows: list[str] = []
        inner = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            depth = len(line) - len(line.lstrip(" "))
            if line.strip():
                if depth <= indent:
                    break
                inner = depth if inner is None else inner
            rows.append(line[inner or 0 :] if line.strip() else "")
            self.at += 1
        end = len(rows)
        while end and not rows[end - 1]:
            end -= 1
        if style == "|":
            out = "\n".join(rows[:end])
        else:
            out = re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(rows[:end])).replace("\n\n", "\n")
        return out if strip or not end else out + "\n" * (len(rows) - end + 1 if keep else 1)

    def scalar(self, s: str, indent: int) -> Any:
        s = s.strip()
        if s[:1] == '"':
            m = re.match(r'"((?:[^"\\]|\\.)*)"', s, re.S)
            return re.sub(r'\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)', _escape, m[1], flags=re.S)
        if s[:1] == "'":
            return re.match(r"'((?:[^']|'')*)'", s, re.S)[1].replace("''", "'")
        if s[:1] in "[{":
            value, rest = _flow(s)
            if rest.strip() and not rest.strip().startswith("#"):
                raise YamlError(f"after a flow value: {rest!r}")
            return value
        s = re.sub(r"\s+#.*$", "", s)
        if s[:1] in "&*!%@`":
            raise YamlError(f"not supported: {s[:20]!r}")
        if s in ("", "~", "null", "Null", "NULL"):
            return None
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        if _INT.match(s):
            return int(s)
        return float(s) if _FLOAT.match(s) else s


def _escape(m: re.Match) -> str:
    c = m[1]
    if c[0] in "xu" and len(c) > 1:
        return chr(int(c[1:], 16))
    return {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "b": "\b", "\n": ""}.get(c, c)


def _flow(s: str) -> tuple[Any, str]:
    s = s.lstrip()
    if s[:1] in "[{":
        closer, rest = {"[": "]", "{": "}"}[s[0]], s[1:].lstrip()
        items: list = []
        pairs: dict = {}
        while not rest.startswith(closer):
            if not rest:
                raise YamlError("open flow value")
            value, rest = _flow(rest)
            rest = rest.lstrip()
            if closer == "}":
                key = str(value)
                if not rest.startswith(":"):
                    pairs[key] = None
                else:
                    pairs[key], rest = _flow(rest[1:])
                    rest = rest.lstrip()
            else:
                items.append(value)
            if rest.startswith(","):
                rest = rest[1:].lstrip()
        return (pairs if closer == "}" else items), rest[1:]
    m = re.match(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')""", s)
    if m is None:
        m = re.match(r"(?:[^,\[\]{}:]|:(?!\s|$))*", s)
    return _Reader([]).scalar(m[0], 0), s[m.end() :]


def dump(value: Any, indent: int = 0) -> str:
    """Block style; strings are quoted where they need it."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        rows = []
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                rows.append(f"{pad}{k}:\n{dump(v, indent + 2)}")
            else:
                rows.append(f"{pad}{k}: {_scalar(v)}")
        return "\n".join(rows)
    if isinstance(value, list) and value:
        rows = []
        for v in value:
            if isinstance(v, (dict, list)) and v:
                rows.append(f"{pad}- {dump(v, indent + 2).lstrip()}")
            else:
                rows.append(f"{pad}- {_scalar(v)}")
        return "\n".join(rows)
    return pad + _scalar(value)


def _scalar(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (dict, list)):
        return "{}" if isinstance(v, dict) else "[]"
    return v if re.fullmatch(r"[A-Za-z][A-Za-z0-9 _./()-]*", v) and v.lower() not in ("true", "false", "null") and not v.endswith(" ") else json.dumps(v, ensure_ascii=False)
