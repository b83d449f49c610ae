"""Five dialects of globs, each compiled to sequences of steps over the segments of a path.

A step is a pair of kind and text. ``is`` takes a segment with this text,
``end`` one whose extension is the text, ``like`` one that the expression
matches, and ``deep`` any number of segments, none included. A glob may become
several sequences; a path matches if one of them takes all its segments.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = tuple[str, str]

#: Where each dialect is used: paths to leave out of a scan, source files to read, units of a package,
#: files that a rule visits, document directories to leave out, and parts of paths to leave out of a rule.
DIALECTS = ("ignored", "sources", "units", "visited", "directories", "parts")

DEEP: Step = ("deep", "")
ANY: Step = ("like", "[^/]*")


def segment_regex(glob: str) -> str | None:
    """The expression for one segment: ``*``, ``?``, ``[..]``, ``[^..]`` and ``\\`` before a character; None if it is malformed."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if at == len(glob):
                return None
            out.append(_exact(glob[at]))
            at += 1
        elif c == "[":
            body, at = _class(glob, at)
            if body is None:
                return None
            out.append(body)
        else:
            out.append(_exact(c))
    return "".join(out)


def _exact(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_/ -])", r"\\\1", text)


def _class(glob: str, at: int) -> tuple[str | None, int]:
    """The character class that starts behind its bracket, and where it ends."""
    negated = glob[at : at + 1] == "^"
    at += negated
    ranges: list[str] = []

    def one(at: int) -> tuple[str | None, int]:
        if at < len(glob) and glob[at] == "\\":
            at += 1
        elif at < len(glob) and glob[at] in "-]":
            return None, at
        return (glob[at], at + 1) if at < len(glob) else (None, at)

    while True:
        if at < len(glob) and glob[at] == "]" and ranges:
            body = "".join(ranges)
            return (f"[{'^' * negated}{body}]" if body else "[\\s\\S]" if negated else "(?!)"), at + 1
        low, at = one(at)
        if low is None:
            return None, at
        high = low
        if at < len(glob) and glob[at] == "-":
            high, at = one(at + 1)
            if high is None:
                return None, at
        if low <= high:
            ranges.append(re.sub(r"([^0-9A-Za-z])", r"\\\1", low) + ("" if low == high else "-" + re.sub(r"([^0-9A-Za-z])", r"\\\1", high)))
        else:
            ranges.append("")  # an empty range takes nothing


def _step(segment: str) -> Step | None:
    if not re.search(r"[*?\[\\]", segment):
        return ("is", segment)
    if re.fullmatch(r"\*\.[^.*?\[\]\\]+", segment):
        return ("end", segment[1:])
    regex = segment_regex(segment)
    return None if regex is None else ("like", regex)


def _literal(text: str) -> list[Step]:
    return [("is", s) for s in text.split("/")]


def _whole(pattern: str) -> list[list[Step]]:
    """The pattern segment by segment; ``**`` is as ``*`` here."""
    steps = [_step(s) for s in pattern.split("/")]
    return [] if None in steps else [steps]


def _holding(text: str) -> list[list[Step]]:
    """Paths that hold a text anywhere, across segments too."""
    if not text:
        return [[DEEP]]
    first, *rest = text.split("/")
    if not rest:
        return [[DEEP, ("like", f"[^/]*{_exact(first)}[^/]*"), DEEP]]
    return [[DEEP, ("like", f"[^/]*{_exact(first)}"), *(("is", s) for s in rest[:-1]), ("like", f"{_exact(rest[-1])}[^/]*"), DEEP]]


def _below(pattern: str) -> list[list[Step]]:
    """All paths for ``**``; for a pattern with one ``/**``, what lies below a directory of that name, wherever it is."""
    if pattern == "**":
        return [[DEEP]]
    parts = pattern.split("/**")
    below = [[DEEP, *_literal(parts[0]), ANY, DEEP]] if len(parts) == 2 and parts[0] else []
    return below + _whole(pattern)


def compiled(pattern: str, dialect: str) -> list[list[Step]]:
    """The sequences of steps of a glob; none if it can match nothing."""
    if dialect == "ignored":
        return _below(pattern)
    if dialect == "sources":
        tail = pattern.removeprefix("**/*") if pattern.startswith("**/*") else None
        if tail is None:
            return _below(pattern)
        first, *rest = tail.split("/")
        ending = [[DEEP]] if not tail else [[DEEP, ("like", f"[^/]*{_exact(first)}"), *(("is", s) for s in rest)]]
        return _below(pattern) + ending
    if dialect == "units":
        steps = [DEEP if s == "**" else _step(s) for s in posixpath.normpath(pattern).split("/")]
        return [] if None in steps else [steps]
    if dialect == "visited":
        directory, _, name = pattern.rpartition("/")
        directory += "/" if "/" in pattern else ""
        if "**" in pattern:
            directory = directory.removesuffix("**/")
        step = _step(name) if name else None
        place = posixpath.normpath(directory) if directory else "."
        return [] if step is None else [[*([] if place == "." else _literal(place)), DEEP, step]]
    if dialect == "directories":
        if "**" in pattern:
            return _whole(pattern) + [[*_literal(pattern.removesuffix("/**").removesuffix("**")), DEEP]]
        return _whole(pattern) + _holding(pattern)
    if dialect == "parts":
        step = None if "/" in pattern else _step(pattern)
        return ([[DEEP, step]] if step else []) + _holding(pattern)
    raise ValueError(f"no dialect {dialect!r}; there are {', '.join(DIALECTS)}")


def regex(patterns: list[str], dialect: str) -> str:
    """One expression for all globs, for few of them and a filter of a scan; matches nothing if there is none."""
    found = []
    for pattern in patterns:
        for steps in compiled(pattern, dialect):
            taken: list[str] = []
            deep = False
            for kind, text in steps:
                if kind == "deep":
                    deep = True
                    continue
                piece = {"is": _exact(text), "end": f"[^/]*{_exact(text)}", "like": f"(?:{text})"}[kind]
                taken.append("(?:[^/]+/)*" * deep + piece)
                deep = False
            found.append("/".join(taken) + "(?:/[^/]+)*" if deep and taken else ".*" if deep else "/".join(taken))
    return "(?s)^(?:" + "|".join(found) + ")$" if found else "(?!)"


def matches(path: Column, patterns: list[str], dialect: str) -> Column:
    """Whether one of the globs matches a path; false for a null path."""
    return F.coalesce(path.rlike(regex(patterns, dialect)), F.lit(False))


class Trie:
    """The sequences of many globs with common beginnings as one: nodes, the edges that a segment takes, and where globs end.

    An edge is (node, key, regex, next). The key is ``=`` and the segment, ``*``
    and its extension, or ``?`` for edges that the expression decides; a
    missing expression takes every segment. Nodes that ``deep`` leads to are
    entered without a segment, so an edge leads to all of them at once.
    """

    def __init__(self, patterns: list[str], dialect: str) -> None:
        self._next: list[dict[Step, int]] = [{}]
        self.ends: list[tuple[int, str]] = []
        for pattern in dict.fromkeys(patterns):
            for steps in compiled(pattern, dialect):
                node = 0
                for step in steps:
                    if step not in self._next[node]:
                        self._next[node][step] = len(self._next)
                        self._next.append({})
                    node = self._next[node][step]
                self.ends.append((node, pattern))
        deep = {after[DEEP] for after in self._next if DEEP in after}
        keys = {"is": "=", "end": "*"}
        self.edges: list[tuple[int, str, str | None, int]] = [(n, "?", None, n) for n in sorted(deep)]
        for node, after in enumerate(self._next):
            for (kind, text), to in after.items():
                if kind != "deep":
                    key, regex = ("?", f"(?s)^{text}$") if kind == "like" else (keys[kind] + text, None)
                    self.edges += [(node, key, regex, n) for n in self.closure(to)]
        self.start = self.closure(0)

    def closure(self, node: int) -> list[int]:
        found = [node]
        while DEEP in self._next[found[-1]]:
            found.append(self._next[found[-1]][DEEP])
        return found
