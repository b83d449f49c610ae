"""Globs as regular expressions, and paths of a project."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored expression: ``*`` and ``?`` stay in a segment, ``**`` spans segments, ``[..]`` and ``{a,b}`` choose."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = end + 1
        elif c == "{" and "}" in pattern[i + 1 :]:
            end = pattern.index("}", i + 1)
            out.append("(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(c) if c not in "/-_" else c)
            i += 1
    return "^" + "".join(out) + "$"


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the patterns."""
    return F.coalesce(path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignored if the path or its base name matches, or it holds a pattern without wildcards as a part."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    found = matches(path, patterns) | matches(base, patterns)
    for p in patterns:
        bare = p.removesuffix("/**").strip("/")
        if bare and not re.search(r"[*?\[{]", bare):
            found = found | F.coalesce(F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{bare}/"), F.lit(False))
    return found


def display_path(root: str, path: str) -> str:
    """A path relative to the root if it lies inside it, with forward slashes."""
    full, top = os.path.normpath(path), os.path.normpath(root)
    return os.path.relpath(full, top).replace(os.sep, "/") if full == top or full.startswith(top + os.sep) else full.replace(os.sep, "/")


def resolve_path(root: str, path: str) -> str:
    return os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))
