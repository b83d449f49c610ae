"""Completion slots: the places of record documents that still need an author, and which documents to look at.

All works on lines outside front matter (``markdown.lines``), on records, and
on paths. The state of comments and blocks is carried over the lines of a file
by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import REQUIRED_FIELDS, ROLES
from .rules import finding, split_role_files, union

# Role, slot, beginning of the heading of its records, and whether a reason may stand in their place.
COLLECTIONS = (("design", "design.components", "Component:", False), ("contract", "contract.records", "Contract:", True), ("spec", "spec.records", "SPEC-", False), ("testing", "testing.records", "TEST-", False))
#: A line that stands where an author has to write.
SCAFFOLD = r'^\s*<!--\s*scaffold\s+slot="([a-z0-9.-]+)"\s*-->\s*$'
SLOT = ("path", "line", "role", "slot", "reason")
NAMES = {"design": "Component", "contract": "Contract", "spec": "SPEC", "testing": "TEST"}
ROLE_OF = dict(ROLES)


def role_of(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    found = F.lit(None).cast("string")
    for file, role in ROLES:
        found = F.when(name == file, F.lit(role)).otherwise(found)
    return found


def _in_comment(body: Column) -> Column:
    """Whether a line is part of an HTML comment, which starts at the beginning of a line: the last start before it, or on it, is not closed."""
    before = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    opens = body.startswith("<!--")
    opened, closed = F.max(F.when(opens, F.col("line"))).over(before), F.max(F.when(body.contains("-->"), F.col("line"))).over(before)
    return opens | F.coalesce(opened > F.coalesce(closed, F.lit(0)), F.lit(False))


def scaffold_slots(lines: DataFrame) -> DataFrame:
    """Marks that a generated document still has; the last of a slot gives its line."""
    slot = F.regexp_extract("body", SCAFFOLD, 1)
    marks = lines.filter(~F.col("fenced")).select("path", "line", slot.alias("slot")).filter("slot <> ''")
    return marks.groupBy("path", "slot").agg(F.max("line").alias("line")).select("path", "line", role_of(F.col("path")).alias("role"), "slot", F.lit("a generated mark is left").alias("reason"))


def collection_slots(lines: DataFrame) -> DataFrame:
    """Role documents without a record; a contract document may say why it has none, in text outside comments, headings and quotes."""
    body = F.trim(F.regexp_replace("body", r"[\t\r]", " "))
    state = lines.withColumn("role", role_of(F.col("path"))).filter("role IS NOT NULL").withColumn("_comment", _in_comment(body))
    text = ~F.col("_comment") & (body != "") & ~body.startswith("#") & ~body.startswith(">")
    head, own = F.col("heading"), F.lit(False)
    slot, optional = F.lit(None).cast("string"), F.lit(False)
    for role, name, prefix, may in COLLECTIONS:
        here = F.col("role") == role
        own = own | here & F.coalesce(head.startswith(prefix) & (F.trim(F.expr(f"substring(heading, {len(prefix) + 1})")) != ""), F.lit(False))
        slot, optional = F.when(here, F.lit(name)).otherwise(slot), F.when(here, F.lit(may)).otherwise(optional)
    found = state.groupBy("path", "role").agg(F.bool_or(own).alias("has"), F.bool_or(text).alias("told"), F.min("line").alias("line"))
    bare = found.filter(~F.col("has") & ~(optional & F.col("told")))
    reason = F.when(optional, "neither a record nor a reason why there is none").otherwise("no record is written")
    return bare.select("path", "line", "role", slot.alias("slot"), reason.alias("reason"))


def section_blocks(lines: DataFrame) -> DataFrame:
    """The blocks below each second-level heading: path, heading, head (its line), block and text.

    A block is a row of lines that are neither blank nor headings, quotes or
    comments; its text is their text without list marks.
    """
    body = F.trim(F.regexp_replace("body", r"[\t\r]", " "))
    file = W.partitionBy("path").orderBy("line")
    state = lines.withColumns({"_text": body, "_comment": _in_comment(body)}).withColumns({
        "head": F.last(F.when(~F.col("fenced") & F.col("body").rlike(r"^ {0,3}##\s"), F.col("line")), ignorenulls=True).over(file),
        "_plain": ~F.col("_comment") & (F.col("_text") != "") & (F.col("fenced") | ~F.col("_text").rlike("^(#|>)")),
    })
    state = state.withColumn("block", F.sum((~F.col("_plain")).cast("int")).over(file)).filter("head IS NOT NULL")
    stripped = F.regexp_replace("_text", r"^([-*+]|[0-9]+[.)])\s+", "")
    joined = state.filter("_plain").groupBy("path", "head", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", stripped.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    heads = state.filter("line = head").select("path", "head", "heading")
    return heads.join(joined, ["path", "head"], "left").select("path", "heading", "head", "block", "text")


def section_slots(lines: DataFrame, sections: list[tuple[str, str, str]]) -> DataFrame:
    """Sections (role, slot, heading) that a role document lacks, or that hold nothing but placeholders."""
    spark = lines.sparkSession
    asked = spark.createDataFrame(sections, "role string, slot string, wanted string")
    documents = lines.groupBy("path").agg(F.min("line").alias("start")).withColumn("role", role_of(F.col("path"))).join(F.broadcast(asked), "role")
    filled = F.coalesce((F.col("text") != "") & ~ids.placeholder(F.col("text")), F.lit(False))
    held = section_blocks(lines).groupBy("path", "head", "heading").agg(F.bool_or(filled).alias("filled"))
    # the first section of a heading, in any case, is the one that counts
    first = held.groupBy("path", F.lower(F.trim("heading")).alias("key")).agg(F.min(F.struct("head", "filled")).alias("s"))
    met = documents.withColumn("key", F.lower("wanted")).join(first, ["path", "key"], "left").filter(F.col("s").isNull() | ~F.col("s.filled"))
    reason = F.concat(F.lit("section "), F.col("wanted"), F.when(F.col("s").isNull(), " is missing").otherwise(" holds nothing"))
    return met.select("path", F.coalesce("s.head", "start").alias("line"), "role", "slot", reason.alias("reason"))


def field_slots(records: DataFrame) -> DataFrame:
    """Required fields of records that are empty or placeholders: role, name of the record and field make the slot."""
    spark = records.sparkSession
    needed = spark.createDataFrame([(r, f, is_list, kind, n) for n, (r, f, is_list, _, optional, kind) in enumerate(REQUIRED_FIELDS) if not optional], "role string, field string, is_list boolean, needed_kind string, ord int")
    plain = ("title", "kind", "purpose", "ownership", "boundary", "decisions", "guarantees", "requirement", "acceptance", "oracle")
    named = F.col("role").isin("design", "contract")
    own = F.coalesce(F.when(named, F.col("title")).otherwise(F.col("id")), F.lit(""))
    values = F.create_map(
        F.lit("name"), F.col("title"), F.lit("id"), F.col("id"), *[x for c in plain for x in (F.lit(c), F.col(c))], *[x for c in ("components", "contracts", "covers") for x in (F.lit(c), F.array_join(c, ", "))]
    )
    each = records.select("path", "role", "kind", "line", "record_index", "field_lines", own.alias("own"), values.alias("values")).join(F.broadcast(needed), "role")
    each = each.filter(F.col("needed_kind").isNull() | (F.col("needed_kind") == F.col("kind")))
    value = F.trim(F.coalesce(F.col("values")[F.col("field")], F.lit("")))
    against = F.when(F.col("field") != "name", F.col("own"))
    blank = (value == "") | F.exists(F.split(value, ","), lambda x: F.coalesce(ids.placeholder(F.trim(x)), F.lit(False)))
    # a value that only repeats the id of its record says nothing; the id itself has no other value
    same = F.coalesce(F.exists(F.split(value, ","), lambda x: F.trim(x) == against), F.lit(False)) & ~F.col("field").isin("id", "name")
    key = F.regexp_replace(F.regexp_replace(F.lower("own"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    key = F.when(key == "", F.concat(F.lit("record-"), (F.col("record_index") + 1).cast("string"))).otherwise(key)
    kind = F.create_map(*[x for r, n in NAMES.items() for x in (F.lit(r), F.lit(n))])[F.col("role")]
    shown = F.when(F.col("own") == "", F.concat(F.lit("record "), (F.col("record_index") + 1).cast("string"))).otherwise(F.col("own"))
    return each.filter(blank | same).select(
        "path", F.coalesce(F.col("field_lines")[F.col("field")], "line").alias("line"), "role", F.concat_ws(".", "role", key, "field").alias("slot"),
        F.concat_ws(" ", kind, shown, F.lit("needs content for"), "field").alias("reason"), (F.col("record_index") * 100 + F.col("ord")).alias("ord"),
    )


def first_of_each(parts: list[DataFrame]) -> DataFrame:
    """The slots of all parts (path, line, role, slot, reason), one of each path and slot: that of the first part that has it."""
    ranked = [p.select(*SLOT, F.lit(n).alias("_part"), (F.col("ord") if "ord" in p.columns else F.lit(0)).alias("_ord")) for n, p in enumerate(parts)]
    whole = ranked[0]
    for p in ranked[1:]:
        whole = whole.unionByName(p)
    first = whole.groupBy("path", "slot").agg(F.min(F.struct("_part", "_ord", "line", "role", "reason")).alias("s"))
    return first.select("path", F.col("s.line").alias("line"), F.col("s.role").alias("role"), "slot", F.col("s.reason").alias("reason"))


def ordered(found: DataFrame) -> DataFrame:
    """Slots by path, line and name."""
    return found.orderBy("path", "line", "slot")


def targets(files: DataFrame, target: str = ".", sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an inspection of a directory looks at: documents (path, role), slots of role files that are missing, and findings.

    ``files`` (path, identity) are all Markdown files, ``identity`` saying that
    a file describes itself as a record document. Every directory with one is
    looked at, and the directory of the inspection itself if ``sources``
    (path) has a file in the package that it documents. Split role files, and
    other files with an identity, are findings.
    """
    top = target.strip("/")
    inside = files if top in ("", ".") else files.filter(F.col("path").startswith(f"{top}/"))
    place = F.regexp_extract("path", "^(.*?)/?[^/]*$", 1)
    own = inside.withColumns({"directory": place, "role": role_of(F.col("path"))})
    split = split_role_files(inside)
    stray = own.filter("identity AND role IS NULL").join(split.select(F.col("source").alias("path")), "path", "left_anti")
    stray = stray.select(*finding("error", "document-filename", F.lit("only role files have an identity"), F.col("path"), None, F.lit("noncanonical-role")))
    held = own.filter("identity AND role IS NOT NULL").select("directory").distinct()
    parts = top.split("/")
    if sources is not None and "docs" in parts:
        package = "/".join([*parts[: len(parts) - 1 - parts[::-1].index("docs")], *parts[len(parts) - parts[::-1].index("docs") :]])
        due = sources.filter(place == package).limit(1).select(F.lit(top).alias("directory")) if package != "/".join(parts[:-1]) else None
        held = held.union(due).distinct() if due is not None else held
    required = F.array(*[F.struct(F.lit(f).alias("file"), F.lit(r).alias("role")) for f, r in ROLES])
    each = held.select("directory", F.explode(required).alias("r")).select(F.concat_ws("/", F.nullif("directory", F.lit("")), "r.file").alias("path"), "r.role")
    met = each.join(inside.select("path", F.lit(True).alias("found")).distinct(), "path", "left")
    missing = met.filter("found IS NULL").select("path", F.lit(1).alias("line"), "role", F.concat("role", F.lit(".document")).alias("slot"), F.lit("a required document is missing").alias("reason"))
    return met.filter("found").select("path", "role"), missing, union([split, stray])


def inspect(lines: DataFrame, records: DataFrame, looked_at: DataFrame, missing: DataFrame, sections: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """All slots of the documents ``looked_at`` (path) and the ``missing`` ones, one of each name in a document."""
    own = lines.join(looked_at.select("path"), "path", "left_semi")
    parts = [scaffold_slots(own), collection_slots(own)]
    parts += [section_slots(own, sections)] if sections else []
    parts += [field_slots(records.join(looked_at.select("path"), "path", "left_semi"))]
    return first_of_each([*parts, missing])


def statuses(looked_at: DataFrame, found: DataFrame) -> DataFrame:
    """path, slots (in number) and status of each document looked at, and of those that are missing: complete if there is no slot."""
    each = looked_at.select("path").union(found.select("path")).distinct()
    return each.join(found.groupBy("path").agg(F.count("*").alias("slots")), "path", "left").select("path", F.coalesce("slots", F.lit(0)).alias("slots"), F.when(F.col("slots").isNull(), "complete").otherwise("incomplete").alias("status"))
