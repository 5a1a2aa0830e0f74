"""Rule templates: matchers that decide whether a rule applies to a text, and extractors of the values."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from spillway.detect import dialect
from spillway.detect.model import entropy
from spillway.rules import yamlite

SEVERITIES = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Matcher:
    type: str
    words: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    condition: str = "or"
    min: float = 0.0
    negative: bool = False


@dataclass(frozen=True)
class Extractor:
    regex: tuple[str, ...]
    group: int | None = None  # None: the first group, if there is one


@dataclass(frozen=True)
class Template:
    id: str
    severity: str = ""
    category: str = ""
    condition: str = "and"
    matchers: tuple[Matcher, ...] = ()
    extractors: tuple[Extractor, ...] = ()
    name: str = ""
    tags: tuple[str, ...] = ()
    author: str = ""
    description: str = ""
    reference: tuple[str, ...] = field(default=())
    path: str = ""

    @property
    def any_of(self) -> bool:
        return self.condition.lower() == "or"

    @cached_property
    def anchors(self) -> tuple[str, ...]:
        """Lower-case words of which a text must hold one for any hit; none means that the template always runs."""
        words = tuple(w.lower() for m in self.matchers if m.type == "word" and not m.negative for w in m.words)
        if self.any_of and not all(m.type == "word" and not m.negative for m in self.matchers):
            return ()
        return words

    @cached_property
    def floor(self) -> float:
        return max((m.min for m in self.matchers if m.type == "entropy"), default=0.0)

    @cached_property
    def _values(self) -> tuple[tuple[re.Pattern, int], ...]:
        """Patterns and groups that give the values."""
        if any(e.regex for e in self.extractors):
            pairs = [(rx, 1 if e.group is None else e.group) for e in self.extractors for rx in e.regex]
        else:
            pairs = [(rx, 1) for m in self.matchers if m.type == "regex" for rx in m.regex]
        return tuple((dialect.compiled_bytes(rx), g) for rx, g in pairs)

    @cached_property
    def _needs(self) -> tuple[tuple[bytes, ...], ...]:
        """For each pattern of the values the literals of which it needs one."""
        return tuple(dialect.required(rx.pattern) for rx, _ in self._values)

    @cached_property
    def _heads(self) -> tuple[tuple[tuple[bytes, int], ...], ...]:
        return tuple(dialect.heads(rx.pattern) for rx, _ in self._values)

    @cached_property
    def _tests(self) -> tuple[tuple[Matcher, tuple], ...]:
        return tuple((m, tuple(w.lower().encode() for w in m.words) if m.type == "word" else tuple(map(dialect.compiled_bytes, m.regex))) for m in self.matchers)

    def applies(self, text: bytes, low: bytes) -> bool:
        results = []
        for m, tests in self._tests:
            if m.type == "entropy":
                ok = True
            else:
                each = ((t in low) if m.type == "word" else t.search(text) is not None for t in tests)
                ok = bool(tests) and (all(each) if m.condition.lower() == "and" else any(each))
            ok ^= m.negative
            if ok == self.any_of:
                return ok
            results.append(ok)
        return bool(results) and not self.any_of

    def hits(self, text: bytes, low: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(value, start, end), each value once; without patterns the whole text."""
        if self._values and not any(not need or any(x in text for x in need) for need in self._needs) or not self.applies(text, low):
            return
        if not self._values:
            if entropy(text) >= self.floor or not self.floor:
                yield text, 0, len(text)
            return
        seen = set()
        for (rx, group), heads in zip(self._values, self._heads):
            for m in dialect.search(rx, heads, text, low):
                lo, hi = m.span(group if 0 < group <= rx.groups else 0)
                value = text[lo:hi]
                if lo < 0 or value in seen or (self.floor and entropy(value) < self.floor):
                    continue
                seen.add(value)
                yield value, lo, hi


def _tuple(x) -> tuple[str, ...]:
    if x is None:
        return ()
    return (str(x),) if not isinstance(x, list) else tuple(map(str, x))


def tag_list(tags) -> tuple[str, ...]:
    parts = tags if isinstance(tags, list) else str(tags or "").split(",")
    return tuple(t for t in (str(p).strip().lower() for p in parts) if t)


def from_doc(doc: dict, path: str = "") -> Template:
    info = doc.get("info") or {}
    return Template(
        str(doc.get("id") or ""), str(info.get("severity") or "").lower(), str(doc.get("category") or ""), str(doc.get("matchers-condition") or "and"),
        tuple(Matcher(str(m.get("type") or ""), _tuple(m.get("words")), _tuple(m.get("regex")), str(m.get("condition") or "or"), float(m.get("min") or 0), bool(m.get("negative"))) for m in doc.get("matchers") or ()),
        tuple(Extractor(_tuple(e.get("regex")), None if "group" not in e else int(e["group"] or 0)) for e in doc.get("extractors") or ()),
        str(info.get("name") or ""), tag_list(info.get("tags")), str(info.get("author") or ""), str(info.get("description") or ""), _tuple(info.get("reference")), path,
    )


def to_doc(t: Template) -> dict:
    info = {"name": t.name, "author": t.author, "severity": t.severity, "description": t.description, "reference": list(t.reference), "tags": ",".join(t.tags)}
    out: dict = {"id": t.id, "info": {k: v for k, v in info.items() if v}}
    if t.category:
        out["category"] = t.category
    out["matchers-condition"] = t.condition
    out["matchers"] = [
        {"type": m.type} | ({"words": list(m.words)} if m.words else {}) | ({"regex": list(m.regex)} if m.regex else {}) | ({"condition": m.condition} if m.condition != "or" else {}) | ({"min": m.min} if m.min else {}) | ({"negative": True} if m.negative else {})
        for m in t.matchers
    ]
    if t.extractors:
        out["extractors"] = [{"type": "regex", "regex": list(e.regex)} | ({} if e.group is None else {"group": e.group}) for e in t.extractors]
    return out


def loads(text: str, path: str = "") -> list[Template]:
    """Templates of a file, empty documents left out."""
    return [from_doc(d, path) for d in yamlite.load_all(text) if d]


def load_dir(folder: str) -> list[Template]:
    """Templates of all .yaml and .yml files below a folder, in order of path; the first of an id stays."""
    out: dict[str, Template] = {}
    for p in sorted(q for q in Path(folder).rglob("*") if q.suffix in (".yaml", ".yml") and q.is_file()):
        for t in loads(p.read_text(), str(p.relative_to(folder))):
            if all(map(dialect.is_safe, [rx for m in t.matchers for rx in m.regex] + [rx for e in t.extractors for rx in e.regex])):
                out.setdefault(t.id, t)
    return list(out.values())


def select(templates: Iterable[Template], ids=(), exclude_ids=(), severities=(), tags=(), exclude_tags=()) -> list[Template]:
    low = lambda xs: {x.lower() for x in xs}
    ids, exclude_ids, severities, tags, exclude_tags = map(low, (ids, exclude_ids, severities, tags, exclude_tags))
    return [
        t for t in templates
        if (not ids or t.id.lower() in ids) and t.id.lower() not in exclude_ids and (not severities or t.severity.lower() in severities)
        and (not tags or tags & set(t.tags)) and not exclude_tags & set(t.tags)
    ]


def lint(t: Template) -> list[str]:
    """What is wrong with a template."""
    out = []
    if not re.fullmatch(r"[a-z0-9][a-z0-9\-]*", t.id):
        out.append("id: not lower-case words joined by -")
    if not t.name:
        out.append("name: missing")
    if t.severity not in SEVERITIES:
        out.append(f"severity: {t.severity or 'missing'}")
    if not t.tags:
        out.append("tags: missing")
    if not t.category:
        out.append("category: missing")
    if not t.matchers:
        out.append("matchers: missing")
    patterns = [rx for m in t.matchers for rx in m.regex] + [rx for e in t.extractors for rx in e.regex]
    for rx in patterns:
        if not dialect.is_safe(rx):
            out.append(f"regex: unsafe or wrong: {rx[:60]}")
        elif dialect.backtracks(rx):
            out.append(f"regex: a repeated group repeats without bound: {rx[:60]}")
    for m in t.matchers:
        if m.type not in ("word", "regex", "entropy"):
            out.append(f"matcher: unknown type {m.type}")
        elif m.type == "word" and not m.words or m.type == "regex" and not m.regex:
            out.append(f"matcher: empty {m.type}")
    if any(m.type == "entropy" for m in t.matchers) and not patterns:
        out.append("entropy: without a regex it measures the whole text")
    if patterns and not t.anchors:
        out.append("anchor: none, so the rule runs on every text")
    return out


def duplicates(templates: Iterable[Template]) -> list[str]:
    seen: set[str] = set()
    return [t.id for t in templates if t.id in seen or seen.add(t.id)]


def manifest(files: dict[str, bytes]) -> str:
    """A line of sha256 and path for each file, in order of path."""
    return "".join(f"{hashlib.sha256(b).hexdigest()}  {p}\n" for p, b in sorted(files.items()))


def verify_manifest(files: dict[str, bytes], text: str) -> list[str]:
    """What differs from the manifest; any difference rejects the set."""
    want = dict(reversed(line.split(maxsplit=1)) for line in text.splitlines() if line.strip())
    out = [f"missing: {p}" for p in sorted(want.keys() - files.keys())] + [f"not listed: {p}" for p in sorted(files.keys() - want.keys())]
    return out + [f"changed: {p}" for p in sorted(want.keys() & files.keys()) if hashlib.sha256(files[p]).hexdigest() != want[p]]


def near_misses(templates: Iterable[Template], text: str, most: int = 3) -> list[tuple[str, float, list[str]]]:
    """The rules that came closest to a hit: (id, share of matchers that hold, which ones don't)."""
    b = text.encode()
    low = b.lower()
    out = []
    for t in templates:
        ok = [bool(tests) and any((x in low) if m.type == "word" else x.search(b) is not None for x in tests) if m.type != "entropy" else True for m, tests in t._tests]
        if any(o for o, (m, _) in zip(ok, t._tests) if m.type != "entropy"):
            out.append((t.id, sum(ok) / len(ok), [m.type for o, (m, _) in zip(ok, t._tests) if not o]))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:most]
