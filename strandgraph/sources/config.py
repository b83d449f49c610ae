"""Configuration of a project: read, completed and checked on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from ..functions.globs import glob_regex

# Switches and their defaults, and names that are no longer used.
SWITCHES = {
    "spec_test_coverage": True, "contract_test_coverage": True, "design_sections": True, "spec_fields": True, "doc_link_consistency": True, "correspondence": True,
    "related_files": True, "package_doc_files": True, "annotation_identifier": True, "public_annotations": False, "test_annotations": False, "allow_orphans": False, "identifier_format": True,
}
OBSOLETE = ("docs.catalog", "validation.min_coverage")
FILES = ("trace.yaml", "config/trace.yaml")


@dataclass
class Unit:
    package: str
    patterns: list[str]


@dataclass
class Config:
    root: str = "."
    doc_patterns: list[str] = field(default_factory=lambda: ["docs/**/*.md"])
    code_patterns: list[str] = field(default_factory=lambda: ["**/*"])
    ignore: list[str] = field(default_factory=lambda: [".git/**", "node_modules/**", "vendor/**"])
    docs_ignore: list[str] = field(default_factory=lambda: [".git/**", "node_modules/**", "vendor/**"])
    annotations: dict[str, str] = field(default_factory=lambda: {"implement": "@implement", "test": "@test", "test_contract": "@test-contract"})
    units: list[Unit] = field(default_factory=list)
    switches: dict[str, bool] = field(default_factory=lambda: dict(SWITCHES))
    notices: list[str] = field(default_factory=list)


def load(path: str) -> Config:
    """The configuration in a file; raises ValueError if it breaks a rule."""
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping")
    config = Config(root=os.path.dirname(os.path.abspath(path)))
    docs, code = raw.get("docs") or {}, raw.get("code") or {}
    config.doc_patterns = docs.get("patterns") or config.doc_patterns
    config.code_patterns = code.get("patterns") or config.code_patterns
    config.ignore = code.get("ignore_paths") or config.ignore
    config.docs_ignore = docs.get("ignore_paths") or config.docs_ignore
    config.annotations |= raw.get("annotations") or {}
    config.units = [Unit(u.get("package", ""), list(u.get("patterns") or [])) for u in docs.get("units") or []]
    config.switches |= raw.get("rules") or {}
    for name in OBSOLETE:
        at = raw
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            config.notices.append(f"{name} is not used any more")
    check(config)
    return config


def check(config: Config) -> None:
    """Refuses unknown switches and annotations, blank or repeated marks, and units or globs that cannot match."""
    if unknown := set(config.switches) - set(SWITCHES):
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    if set(config.annotations) != {"implement", "test", "test_contract"}:
        raise ValueError("annotations are implement, test and test_contract")
    marks = list(config.annotations.values())
    if any(not m or m != m.strip() or re.search(r"\s", m) for m in marks) or len(set(marks)) < len(marks):
        raise ValueError("annotation marks are distinct words")
    seen: set[str] = set()
    for unit in config.units:
        if not unit.package or unit.package in seen or not unit.patterns:
            raise ValueError("a unit has a package of its own and patterns")
        seen.add(unit.package)
    for pattern in [*config.doc_patterns, *config.code_patterns, *config.ignore, *[p for u in config.units for p in u.patterns]]:
        if not pattern or pattern.startswith("/") or ".." in pattern.split("/"):
            raise ValueError(f"not a project glob: {pattern!r}")
        re.compile(glob_regex(pattern))


def discover(root: str, explicit: str | None = None) -> Config:
    """The explicit file, else the first default file that loads, else the defaults."""
    if explicit:
        return load(explicit)
    for name in FILES:
        path = os.path.join(root, name)
        if os.path.exists(path):
            try:
                return load(path)
            except ValueError:
                break
    return Config(root=root)


def docs_roots(config: Config) -> list[str]:
    """The folders called ``docs`` that document patterns lie in: of the literal beginning of a pattern, the deepest; none for other patterns."""
    roots = set()
    for pattern in config.doc_patterns:
        literal = re.split(r"[*?\[]", pattern, maxsplit=1)[0].rstrip("/")
        parts = [p for p in literal.split("/") if p not in ("", ".")]
        if parts and "." in parts[-1]:
            parts.pop()
        if "docs" in parts:
            roots.add("/".join(parts[: len(parts) - parts[::-1].index("docs")]))
    return sorted(roots)
