"""Options of a scan: defaults, a YAML file over them, and flags over both (OPS-02, FLT-04, SET-04)."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from spillway.detect import dialect, table
from spillway.detect.kernel import Allow
from spillway.functions.text import parse_size
from spillway.rules import catalogue, template, yamlite
from spillway.schema import SEVERITIES


@dataclass(frozen=True)
class Options:
    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    custom: tuple[table.Detector, ...] = ()
    rulesets: tuple[str, ...] = ()
    rules_dir: str = ""
    rules: bool = True
    rules_only: bool = False
    tags: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    rule_severity: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_size: int = 10 << 20
    max_per_file: int = 30
    dedupe: bool = True
    min_confidence: float = 0.0
    min_severity: str = ""
    fail_on: str = ""
    format: str = "pretty"
    show_secrets: bool = False
    baseline: str = ""
    ignore: str = ""
    allow: Allow = field(default_factory=Allow)

    def detectors(self) -> list[table.Detector]:
        if self.rules_only:
            return []
        extra = [table.load(Path(p).read_text()) for p in self.rulesets]
        return table.enabled(table.merge(table.BUILTIN, *extra), self.enable, self.disable, self.custom)

    def templates(self) -> tuple[template.Template, ...]:
        if not self.rules:
            return ()
        found = template.load_dir(self.rules_dir) if self.rules_dir else catalogue.templates()
        return tuple(template.select(found, severities=self.rule_severity, tags=self.tags, exclude_tags=self.exclude_tags))


#: Section, key and field of what a file may hold.
_KEYS = {
    ("detectors", "enable"): "enable", ("detectors", "disable"): "disable", ("detectors", "custom"): "custom", ("detectors", "rulesets"): "rulesets", ("detectors", "rules_dir"): "rules_dir",
    ("detection", "tags"): "tags", ("detection", "exclude_tags"): "exclude_tags", ("detection", "rule_severity"): "rule_severity", ("detection", "min_confidence"): "min_confidence",
    ("output", "format"): "format", ("output", "min_severity"): "min_severity", ("output", "fail_on"): "fail_on", ("output", "show_secrets"): "show_secrets", ("output", "dedupe"): "dedupe", ("output", "max_per_file"): "max_per_file",
    ("limits", "max_size"): "max_size", ("limits", "exclude"): "exclude",
}
_ALLOW = {"values", "paths", "regexes", "stopwords"}
FORMATS = ("pretty", "json", "sarif", "defectdojo")


def lint(doc: dict[str, Any]) -> list[str]:
    """What a file holds that isn't known or right, with a guess at what was meant."""
    sections = {s for s, _ in _KEYS} | {"allowlist"}
    out = []

    def unknown(name: str, known: set[str], where: str) -> None:
        near = difflib.get_close_matches(name, sorted(known), 1)
        out.append(f"{where}{name}: not known" + (f", did you mean {near[0]}?" if near else ""))

    for section, body in (doc or {}).items():
        if section not in sections:
            unknown(section, sections, "")
            continue
        known = _ALLOW if section == "allowlist" else {k for s, k in _KEYS if s == section}
        for key in body or {}:
            if key not in known:
                unknown(key, known, f"{section}.")
    for rx in ((doc or {}).get("allowlist") or {}).get("regexes") or []:
        if not dialect.is_safe(rx):
            out.append(f"allowlist.regexes: unsafe or wrong: {rx[:60]}")
    o = ((doc or {}).get("output")) or {}
    for key in ("min_severity", "fail_on"):
        if o.get(key) and o[key] not in SEVERITIES:
            out.append(f"output.{key}: not a severity: {o[key]}")
    if o.get("format") and o["format"] not in FORMATS:
        out.append(f"output.format: not known: {o['format']}")
    known_types = {d.id for d in table.BUILTIN} | {c.get("id") for c in ((doc or {}).get("detectors") or {}).get("custom") or []}
    for key in ("enable", "disable"):
        for t in ((doc or {}).get("detectors") or {}).get(key) or []:
            if t not in known_types:
                unknown(t, known_types - {None}, f"detectors.{key}: ")
    return out


def _value(name: str, v: Any) -> Any:
    if name == "custom":
        return tuple(table.Detector(c["id"], c.get("category", "generic"), c["regex"], tuple(k.lower() for k in c.get("keywords") or ()), int(c.get("group") or 0), source="custom") for c in v or ())
    if name == "max_size":
        return v if isinstance(v, int) else parse_size(str(v))
    return tuple(v) if isinstance(v, (list, tuple)) else v


def resolve(text: str = "", **flags: Any) -> Options:
    """Options of a file's text, with flags over it; a flag of None isn't set."""
    doc = yamlite.load(text) or {}
    found = {f: _value(f, doc[s][k]) for (s, k), f in _KEYS.items() if (doc.get(s) or {}).get(k) is not None}
    a = doc.get("allowlist") or {}
    allow = Allow(frozenset(a.get("values") or ()), *(tuple(a.get(k) or ()) for k in ("paths", "regexes", "stopwords")))
    out = replace(Options(allow=allow), **found)
    names = {f.name for f in fields(Options)}
    return replace(out, **{k: _value(k, v) for k, v in flags.items() if v is not None and k in names})
