"""Changes of a working tree against a revision, read on the driver."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..schemas import CHANGES, HUNKS

# Status letters.
STATUS = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "T": "type-changed", "U": "unmerged"}


def name_status(raw: bytes) -> list[tuple[str, str | None, str]]:
    """path, old path and status from NUL-separated records; renames and copies have two paths."""
    parts = raw.split(b"\0")
    if parts and parts[-1] == b"":
        parts.pop()
    found, i = [], 0
    while i < len(parts):
        letter = parts[i].decode()[:1]
        width = 2 if letter in "RC" else 1
        if i + width >= len(parts) or not letter:
            raise ValueError("the list of changes is cut off")
        paths = [p.decode() for p in parts[i + 1 : i + 1 + width]]
        found.append((paths[-1], paths[0] if width == 2 else None, STATUS.get(letter, letter.lower())))
        i += 1 + width
    return found


def patch(text: str) -> tuple[list[tuple[int, int, int, int]], list[str]]:
    """Hunk ranges (a missing count is 1) and the SPEC and TEST ids on changed lines, sorted."""
    hunks, ids = [], set()
    for line in text.split("\n"):
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            hunks.append((int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)))
        elif line[:1] in "+-" and not line.startswith(("+++", "---")):
            ids |= set(re.findall(r"\b(?:SPEC|TEST)-[A-Z][A-Z0-9_]*-[0-9]+\b", line.upper()))
    return hunks, sorted(ids)


def sections(text: str) -> list[str]:
    """The parts of a patch, one for each file; no line of a file's text starts as they do."""
    return re.split(r"^diff --git ", text, flags=re.M)[1:]


def collect(root: str, base: str) -> tuple[list[tuple], list[tuple]]:
    """Changes and hunks of the tree at ``root`` since ``base``, untracked files included."""

    def git(*args: str) -> bytes:
        return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout

    commit = git("rev-parse", "--verify", "--end-of-options", f"{base}^{{commit}}").decode().strip()
    changes, hunks = [], []
    named = name_status(git("diff", "--name-status", "-z", "-M", commit, "--"))
    # one patch of all files has a part for each, in the same order; files that change their type, or conflict, have more or none
    parts = sections(git("diff", "--unified=0", "-M", commit, "--").decode(errors="replace"))
    alone = len(parts) != len(named)
    for i, (path, old, status) in enumerate(named):
        text = git("diff", "--unified=0", "-M", commit, "--", *([old] if old else []), path).decode(errors="replace") if alone else parts[i]
        found, ids = patch(text)
        changes.append((path, old, status, ids))
        hunks += [(path, *h) for h in found]
    for raw in git("ls-files", "--others", "--exclude-standard", "-z").split(b"\0"):
        if raw:
            path = raw.decode()
            with open(f"{root}/{path}", errors="replace") as f:
                text = f.read()
            count = text.count("\n") + (not text.endswith("\n") and text != "")
            changes.append((path, None, "untracked", patch("\n".join(f"+{x}" for x in text.split("\n")))[1]))
            hunks.append((path, 0, 0, 1, count))
    return changes, hunks


def changes(spark: SparkSession, root: str, base: str) -> tuple[DataFrame, DataFrame]:
    found, hunks = collect(root, base)
    return spark.createDataFrame(found, CHANGES), spark.createDataFrame(hunks, HUNKS)
