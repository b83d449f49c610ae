"""Markdown records: front matter, fields, paragraphs and lists, as rows.

The parser reads the CommonMark blocks that records use: headings, bullet
lists, paragraphs, fenced code, tables as text and HTML comments. It runs on
whole files in Arrow batches; everything after it is a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialects, ids
from ..schemas import FINDINGS, RECORDS, ROLES

ROLE_OF = dict(ROLES)
#: role -> heading prefix, and the list fields its records may have besides the lifecycle.
FIELDS = {
    "design": ("Component:", ("depends-on",)),
    "contract": ("Contract:", ()),
    "spec": ("SPEC-", ("components", "contracts")),
    "testing": ("TEST-", ("kind", "covers", "contracts")),
}
LIFECYCLE = ("status", "supersedes", "deprecated-by", "concerns")
PARAGRAPHS = {
    "design": ("purpose", "ownership", "boundary", "decisions"),
    "contract": ("guarantees",),
    "spec": ("requirement", "acceptance"),
    "testing": ("purpose", "oracle"),
}


def files(spark: SparkSession, root: str, pattern: str = "*.md", ignore: list[str] | None = None) -> DataFrame:
    """path (relative to ``root``) and content of every file below ``root``; ignored paths are left out before reading."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(top)}/", "")
    rows = found.select(path.alias("path"), F.col("content").cast("string").alias("content"))
    return rows.filter(~dialects.matches(F.col("path"), ignore, "ignored")) if ignore else rows


def front_matter(text: str) -> tuple[str | None, str, int]:
    """The YAML between leading fences, the body, and the number of lines before the body."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    if at == len(lines) or lines[at].rstrip() != "---":
        return None, text, 0
    for end in range(at + 1, len(lines)):
        if lines[end].rstrip() in ("---", "..."):
            return "\n".join(lines[at + 1 : end]), "\n".join(lines[end + 1 :]), end + 1
    raise ValueError("front matter is not closed")


def _plain(text: str) -> str:
    """Text without emphasis and code marks, white space joined."""
    text = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: m[1] or m[2], text)
    text = re.sub(r"(?<![\w*])\*([^*\s][^*]*)\*(?![\w*])", r"\1", text)
    text = re.sub(r"`([^`]*)`", r"\1", text)
    return re.sub(r"\s+", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)).strip()


def blocks(body: str, before: int) -> Iterator[tuple[str, int, int, list[tuple[str, int]]]]:
    """kind, level, line and the (text, line) items of each block; kinds: heading, list, paragraph, code, html."""
    lines, i = body.split("\n"), 0
    while i < len(lines):
        line, at = lines[i], before + i + 1
        fence = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if not line.strip():
            i += 1
        elif fence:
            end = next((j for j in range(i + 1, len(lines)) if re.fullmatch(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*", lines[j])), len(lines))
            yield "code", 0, at, [("\n".join(lines[i + 1 : end]), at)]
            i = end + 1
        elif line.lstrip().startswith("<!--"):
            end = next((j for j in range(i, len(lines)) if "-->" in lines[j]), len(lines) - 1)
            yield "html", 0, at, [("\n".join(lines[i : end + 1]), at)]
            i = end + 1
        elif m := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            yield "heading", len(m[1]), at, [(_plain(m[2] or ""), at)]
            i += 1
        elif re.match(r" {0,3}[-*+]\s+", line):
            items: list[tuple[str, int]] = []
            while i < len(lines) and lines[i].strip() and not re.match(r" {0,3}(#{1,6}\s|`{3,}|~{3,})", lines[i]):
                if re.match(r" {0,3}[-*+]\s+", lines[i]):
                    items.append((re.sub(r"^ {0,3}[-*+]\s+", "", lines[i]), before + i + 1))
                else:
                    items[-1] = (f"{items[-1][0]} {lines[i].strip()}", items[-1][1])
                i += 1
            yield "list", 0, at, [(_plain(t), n) for t, n in items]
        else:
            first = i
            while i < len(lines) and lines[i].strip() and not (i > first and re.match(r" {0,3}(#{1,6}\s|`{3,}|~{3,}|[-*+]\s)|\s*<!--", lines[i])):
                i += 1
            yield "paragraph", 0, at, [(_plain("\n".join(lines[first:i])), at)]


def _listed(value: str) -> list[str]:
    return [x for x in (part.strip().strip("`").strip() for part in (value or "").split(",")) if x]


def parse(path: str, text: str) -> tuple[list[dict], list[tuple]]:
    """The records of one file and its findings; a file without an identity block has neither."""
    import yaml

    try:
        matter, body, before = front_matter(text)
        meta = (yaml.safe_load(matter) or {}) if matter is not None else {}
    except (ValueError, yaml.YAMLError) as error:
        return [], [("error", "document-parse", str(error).split("\n")[0], path, None, None)]
    identity = meta.get("identity") if isinstance(meta, dict) else None
    if not isinstance(identity, dict):
        return [], []
    name = path.rsplit("/", 1)[-1]
    role, found = ROLE_OF.get(name), []
    problem = lambda rule, message, line, link=None, code=None: found.append(("error", rule, message, f"{path}:{line}", link, code))
    if role is None:
        return [], [("error", "document-filename", "a record file has the name of its role", path, None, name)]
    for key in set(identity) - {"version", "package", "namespace"}:
        rule = "document-migration" if key in ("components", "contracts", "specs", "tests") else "document-parse"
        problem(rule, f"identity key {key} does not belong here", 1, code=key)
    prefix, own = FIELDS[role]
    sections: list[dict] = []
    for kind, level, line, items in blocks(body, before):
        if kind == "heading" and level == 2:
            sections.append({"heading": items[0][0], "line": line, "blocks": []})
        elif sections:
            sections[-1]["blocks"].append((kind, level, line, items))
    raw = text.split("\n")
    records = []
    for n, section in enumerate(sections):
        heading = section["heading"]
        if not heading.startswith(prefix):
            continue
        head, _, rest = heading.partition(":")
        values, lines = {}, {}
        if section["blocks"] and section["blocks"][0][0] == "list":
            for item, line in section["blocks"][0][3]:
                label, colon, value = item.partition(":")
                key = re.sub(r"\s+", "-", label.strip().lower())
                if not colon:
                    problem("document-markdown", "a field needs a name and a colon", line, head, "field-format")
                elif key not in own + LIFECYCLE or (key == "depends-on" and role != "design"):
                    problem("document-schema", f"field {label.strip()} is not supported here", line, head, key)
                elif key in values:
                    problem("document-schema", f"field {label.strip()} is repeated", line, head, key)
                else:
                    values[key], lines[key] = value.strip().strip("`").strip(), line
        for label in PARAGRAPHS[role]:
            mark, seen = f"{label.capitalize()}:", False
            for b, (kind, _, line, items) in enumerate(section["blocks"]):
                if kind != "paragraph" or not items[0][0].startswith(mark):
                    continue
                if seen:
                    problem("document-schema", f"{label} is repeated", line, head, label)
                    continue
                seen, value = True, items[0][0][len(mark) :].strip()
                for kind2, _, _, items2 in section["blocks"][b + 1 :] if not value else []:
                    if kind2 == "heading" or kind2 == "paragraph" and items2[0][0].startswith(mark):
                        break
                    if kind2 == "paragraph" and items2[0][0]:
                        value = items2[0][0]
                        break
                values[label], lines[label] = value, line
        named = prefix in ("Component:", "Contract:")
        name_ = rest.strip().strip("`").strip() if named else head.strip()
        package = str(identity.get("package", ""))
        own_id = f"{prefix[:-1].lower()}:{package}#{name_}" if named else name_
        if not name_:
            problem("document-schema", "the heading needs a name", section["line"], None, prefix)
        lines |= {"name" if named else "id": section["line"], "title": section["line"]}
        last = sections[n + 1]["line"] - 1 if n + 1 < len(sections) else len(raw)
        none = lambda x: x or None
        records.append(
            {
                "path": path, "package": package, "namespace": none(str(identity.get("namespace", ""))), "version": none(str(identity.get("version", ""))), "role": role,
                "record_index": len(records), "line": section["line"], "id": own_id, "title": none(name_ if named else rest.strip()), "kind": none(values.get("kind", "").lower()),
                **{p: none(values.get(p, "")) for p in ("purpose", "ownership", "boundary", "decisions", "guarantees", "requirement", "acceptance", "oracle")},
                **{c: _listed(values.get(k, "")) for c, k in (("components", "components"), ("contracts", "contracts"), ("covers", "covers"), ("depends_on", "depends-on"), ("supersedes", "supersedes"))},
                "concerns": [x.lower() for x in _listed(values.get("concerns", ""))], "deprecated_by": none(values.get("deprecated-by", "")), "status": values.get("status", "").lower() or "active",
                "field_lines": lines, "markdown": "\n".join(raw[section["line"] - 1 : last]),
            }
        )
    return records, found


RECORD_COLUMNS = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", RECORDS)]


def records(found: DataFrame) -> DataFrame:
    """The records of ``found`` (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, c in zip(batch.path, batch.content, strict=True) for r in parse(p, c or "")[0]], columns=RECORD_COLUMNS)

    return found.select("path", "content").mapInPandas(read, RECORDS)


def findings(found: DataFrame) -> DataFrame:
    """What is wrong with the text of ``found`` (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([f for p, c in zip(batch.path, batch.content, strict=True) for f in parse(p, c or "")[1]], columns=["severity", "rule", "message", "source", "link", "code"])

    return found.select("path", "content").mapInPandas(read, FINDINGS)


def lines(found: DataFrame) -> DataFrame:
    """path, line and body of every line outside the front matter, with ``fenced`` and the level-2 ``heading`` above it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    _, body, before = front_matter(content or "")
                except ValueError:
                    body, before = content or "", 0
                fence, heading = "", None
                for i, line in enumerate(body.split("\n")):
                    run = re.match(r" {0,3}(`{3,}|~{3,})", line)
                    inside = bool(fence)
                    if run and not fence:
                        fence = run[1]
                    elif run and run[1][0] == fence[0] and len(run[1]) >= len(fence) and not line.strip().strip(fence[0]):
                        fence = ""
                    elif not fence and (m := re.match(r" {0,3}##\s+(.*?)(?:\s+#+)?\s*$", line)):
                        heading = m[1]
                    rows.append((path, before + i + 1, line, inside or bool(run), heading))
            yield pd.DataFrame(rows, columns=["path", "line", "body", "fenced", "heading"])

    return found.select("path", "content").mapInPandas(read, "path string, line int, body string, fenced boolean, heading string")


def raw_lines(found: DataFrame) -> DataFrame:
    """path, line and body of every line of a file, front matter and fences included."""
    rows = found.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("at", "body"))
    return rows.select("path", (F.col("at") + 1).alias("line"), F.regexp_replace("body", "\r$", "").alias("body"))


def mentions(found: DataFrame) -> DataFrame:
    """entity_id, path and line of every plain reference."""
    each = lines(found).select("path", "line", F.explode(ids.loose_references(F.col("body"))).alias("entity_id"))
    return each.select("entity_id", "path", "line").distinct()


def identifiers(found: DataFrame) -> DataFrame:
    """Observations of records, with typed links; a TEST and a SPEC of one package link to each other."""
    link = lambda ref, kind, field, label: F.struct(ref.alias("ref"), F.lit(kind).alias("type"), F.col("path").alias("source"), F.col("field_lines")[field].alias("line"), F.lit(label).alias("field"), F.col("id").alias("record_id"))
    scoped = lambda make: lambda x: make(ids.scope_of(x, F.col("package")), ids.local_name(x))
    component, contract = scoped(ids.component_id), scoped(ids.contract_id)
    same = lambda x: F.when(F.col("role") == "design", component(x)).when(F.col("role") == "contract", contract(x)).otherwise(x)
    many = lambda column, make, kind, field, label, when: F.when(when, F.transform(column, lambda x: link(make(x), kind, field, label))).otherwise(F.array().cast("array<struct<ref:string,type:string,source:string,line:int,field:string,record_id:string>>"))
    role = lambda r: F.col("role") == r
    covers = F.filter("covers", lambda x: ids.well_formed(x) & x.startswith("SPEC-"))
    typed = F.concat(
        many("depends_on", component, "depends_on", "depends-on", "Depends on", role("design")),
        many("components", component, "references", "components", "Components", role("spec")),
        many("contracts", contract, "contract", "contracts", "Contracts", role("spec")),
        many(covers, lambda x: x, "implements", "covers", "Covers", role("testing")),
        many("contracts", contract, "contract_tests", "contracts", "Contracts", role("testing")),
        many("supersedes", same, "supersedes", "supersedes", "Supersedes", F.lit(True)),
        many(F.filter(F.array("deprecated_by"), lambda x: x.isNotNull()), same, "deprecated_by", "deprecated-by", "Deprecated by", F.lit(True)),
    )
    tests = found.filter("role = 'testing'").select("package", "id", "path", "field_lines", F.explode("covers").alias("spec"))
    back = tests.groupBy("package", F.col("spec").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("ref"), F.lit("tests").alias("type"), F.col("path").alias("source"), F.col("field_lines")["covers"].alias("line"), F.lit("Covers").alias("field"), F.col("spec").alias("record_id")))).alias("back")
    )
    joined = found.join(back, ["package", "id"], "left")
    kind = F.when(role("design"), F.lit("component")).when(role("contract"), F.lit("contract")).otherwise(F.col("kind"))
    return joined.filter("id IS NOT NULL").select(
        "id",
        F.when(role("design"), F.lit("DESIGN")).when(role("contract"), F.lit("CONTRACT")).when(role("spec"), F.lit("SPEC")).otherwise(F.lit("TEST")).alias("type"),
        "title",
        F.coalesce("purpose", "guarantees", "requirement").alias("describe"),
        F.col("path").alias("source"),
        "line",
        F.coalesce("title", "id").alias("raw_ref"),
        F.array().cast("array<string>").alias("links"),
        F.when(role("spec") & F.col("back").isNotNull(), F.concat(typed, "back")).otherwise(typed).alias("typed_links"),
        F.lit("doc").alias("origin"),
        "namespace",
        "status",
        F.col("role").alias("document_role"),
        kind.alias("kind"),
        F.col("role").isin("design", "contract").alias("derived"),
        F.col("record_index").cast("long").alias("seq"),
    )
