"""Identifier grammars, inference, lists, locations and bounded text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open an identifier, in each of the four grammars.
TYPES = ("SPEC", "CONTRACT", "TEST", "DESIGN")
REFERENCE_WORDS = "SPEC|CONTRACT|TEST|DESIGN|ARCH|DOC"
PLACEHOLDERS = ("tbd", "todo", "auto-generated", "autogenerated")


def loose_references(text: Column) -> Column:
    """References of any case, upper-cased, that somewhere touch a quote or a backtick."""
    upper = F.upper(text)
    found = F.array_distinct(F.regexp_extract_all(upper, F.lit(rf"\b((?:{REFERENCE_WORDS})-[A-Z0-9_]+-[0-9]+)\b"), F.lit(1)))
    touching = lambda x: upper.contains(F.concat(F.lit('"'), x)) | upper.contains(F.concat(F.lit("`"), x)) | upper.contains(F.concat(x, F.lit('"'))) | upper.contains(F.concat(x, F.lit("`")))
    return F.filter(found, touching)


def strict_case_references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\b((?:{REFERENCE_WORDS})-[A-Z0-9_]+-[0-9]+)\b"), F.lit(1))


def report_identifier(*texts: Column) -> Column:
    """The first identifier in the first text that holds one: link, message, code, source."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, r"\b((?:SPEC|CONTRACT|TEST|DESIGN)-[A-Z0-9_]+-[0-9]+)\b", 1), F.lit("")) for t in texts])


def annotation_ids(text: Column) -> Column:
    """SPEC and TEST identifiers of changed lines, upper-cased, once each, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\b((?:SPEC|TEST)-[A-Z][A-Z0-9_]*-[0-9]+)\b"), F.lit(1))))


def well_formed(ref: Column) -> Column:
    """TYPE-MODULE-NUMBER in three parts; module and number may be empty, the type has any case."""
    return F.coalesce(ref.rlike(r"^(?i:SPEC|CONTRACT|TEST|DESIGN)-[A-Z0-9_]*-[0-9]*$"), F.lit(False))


def parse_type(word: Column) -> Column:
    upper = F.upper(F.trim(word))
    return F.when(upper.isin(*TYPES), upper)


def type_of(ref: Column) -> Column:
    """The type that an identifier's prefix shows; null if none."""
    return (
        F.when(ref.startswith("SPEC-"), F.lit("SPEC"))
        .when(ref.startswith("TEST-"), F.lit("TEST"))
        .when(ref.startswith("CONTRACT-") | ref.startswith("contract:"), F.lit("CONTRACT"))
        .when(ref.startswith("DESIGN-") | ref.startswith("component:"), F.lit("DESIGN"))
    )


def kind_of(ref: Column) -> Column:
    """The entity kind of a reference: spec, test, contract, component, or the table before a colon."""
    typed = F.lower(type_of(ref))
    return F.when(ref.startswith("component:"), F.lit("component")).otherwise(F.coalesce(typed, F.nullif(F.regexp_extract(ref, "^([^:]+):", 1), F.lit(""))))


def namespace_of(ref: Column) -> Column:
    """The scope between colon and hash, or what stands between the first and the last hyphen."""
    scoped = F.regexp_extract(ref, r"^[^:]*:([^#]*)", 1)
    return F.when(ref.contains(":"), scoped).otherwise(F.regexp_extract(ref, r"^[^-]*-(.*)-[^-]*$", 1))


def trace_link_type(from_type: Column, ref: Column) -> Column:
    """The relation of an untyped link, by prefixes alone."""
    to = type_of(ref)
    return (
        F.when((from_type == "SPEC") & (to == "TEST"), F.lit("tests"))
        .when((from_type == "SPEC") & (to == "CONTRACT"), F.lit("contract"))
        .when((from_type == "TEST") & (to == "CONTRACT"), F.lit("contract_tests"))
        .when(from_type == "TEST", F.lit("implements"))
        .when(from_type == "CONTRACT", F.lit("contract_implements"))
        .otherwise(F.lit("references"))
    )


def graph_link_type(from_type: Column, to_type: Column) -> Column:
    """The relation of an untyped link whose target type is known; an unknown target counts as SPEC."""
    to = F.coalesce(to_type, F.lit("SPEC"))
    return (
        F.when((from_type == "SPEC") & (to == "TEST"), F.lit("tests"))
        .when((from_type == "SPEC") & (to == "CONTRACT"), F.lit("contract"))
        .when((from_type == "TEST") & (to == "CONTRACT"), F.lit("contract_tests"))
        .when(from_type == "TEST", F.lit("implements"))
        .when(from_type == "CONTRACT", F.lit("contract_implements"))
        .otherwise(F.lit("references"))
    )


def relation_type(owner_type: Column, ref: Column, link_type: Column) -> Column:
    """The trace name of a relation."""
    return (
        F.when((link_type == "references") & ref.startswith("component:"), F.lit("designed_by"))
        .when(link_type == "contract", F.lit("constrained_by"))
        .when((link_type == "implements") & (owner_type == "TEST"), F.lit("verifies"))
        .when(link_type == "contract_tests", F.lit("proves"))
        .otherwise(link_type)
    )


def relation_field(link_type: Column) -> Column:
    """The field that a relation is written in, where the record does not say."""
    return (
        F.when(link_type.isin("tests", "implements", "verifies"), F.lit("covers"))
        .when(link_type.isin("contract", "contract_tests", "contract_implements", "constrained_by", "proves"), F.lit("contracts"))
        .when(link_type == "designed_by", F.lit("components"))
        .when(link_type.isin("depends_on", "depended_by"), F.lit("depends-on"))
        .when(link_type == "supersedes", F.lit("supersedes"))
        .when(link_type == "deprecated_by", F.lit("deprecated-by"))
        .otherwise(F.lit("reference"))
    )


def split_refs(text: Column, keep_empty: bool = False) -> Column:
    """The trimmed parts of a comma list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def scalar(text: Column) -> Column:
    """A value without white space and backticks around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^`+|`+$", ""))


def reference_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), scalar), lambda x: x != "")


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def heading_id(heading: Column) -> Column:
    return F.trim(F.substring_index(heading, ":", 1))


def heading_title(heading: Column) -> Column:
    return F.when(heading.contains(":"), F.trim(F.regexp_extract(heading, r"^[^:]*:(.*)$", 1))).otherwise(F.lit(""))


def field_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", "-")


def lifecycle(status: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(scalar(status)), F.lit("")), F.lit("active"))


def needs_evidence(status: Column) -> Column:
    return F.coalesce(status, F.lit("active")) == "active"


def package_of(path: Column) -> Column:
    """The directories of a document without its last ``docs`` segment."""
    parts = F.filter(F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/"), lambda x: x != "")
    last = F.size(parts) - F.array_position(F.reverse(parts), "docs")
    rest = F.when(F.array_contains(parts, "docs"), F.concat(F.slice(parts, F.lit(1), last), F.slice(parts, last + 2, F.size(parts)))).otherwise(parts)
    return F.array_join(rest, "/")


def module_of(package: Column) -> Column:
    return F.upper(F.translate(package, "-/", "__"))


def scope_of(name: Column, package: Column) -> Column:
    """The package of a scoped name, or the one it is written in."""
    return F.when(name.contains("#"), F.substring_index(name, "#", 1)).otherwise(package)


def local_name(name: Column) -> Column:
    return F.when(name.contains("#"), F.regexp_extract(name, "#(.*)$", 1)).otherwise(name)


def scoped_name_ok(name: Column) -> Column:
    parts = F.split(name, "#")
    return (F.size(parts) <= 2) & F.forall(parts, lambda x: F.trim(x) != "")


def component_id(package: Column, name: Column) -> Column:
    return F.concat(F.lit("component:"), package, F.lit("#"), name)


def contract_id(package: Column, name: Column) -> Column:
    return F.concat(F.lit("contract:"), package, F.lit("#"), name)


def location_path(location: Column) -> Column:
    return F.regexp_extract(location, r"^(.*?)(?::(\d+))?$", 1)


def location_line(location: Column) -> Column:
    return F.nullif(F.regexp_extract(location, r"^(.*?)(?::(\d+))?$", 2), F.lit("")).cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def humanise(rule: Column) -> Column:
    return F.initcap(F.regexp_replace(rule, "[-_]+", " "))


def placeholder(value: Column, own_id: Column | None = None) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    found = low.isin(*PLACEHOLDERS)
    return found if own_id is None else found | F.coalesce(F.trim(value) == own_id, F.lit(False))


def complete(value: Column, is_list: Column, own_id: Column | None = None) -> Column:
    """Whether a field has content; in a list every item must."""
    items = F.when(is_list, split_refs(value)).otherwise(F.array(F.trim(F.coalesce(value, F.lit("")))))
    return (F.size(items) > 0) & F.forall(items, lambda x: (x != "") & ~placeholder(x, own_id))


def change_status(letter: Column) -> Column:
    """The word for a status letter of a change list."""
    first = F.substring(letter, 1, 1)
    names = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "T": "type-changed", "U": "unmerged", "?": "untracked"}
    found = F.when(first == "M", names["M"])
    for key, name in list(names.items())[1:]:
        found = found.when(first == key, name)
    return found.otherwise(F.lower(letter))


def line_count(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


def cut_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of a text, never part of a character."""
    raw = text.cast("binary")
    byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    ends = F.lit(max(0, limit - 3))
    for back in range(3, -1, -1):
        at = limit - back
        if at >= 0:
            ends = F.when(byte(at + 1).between(128, 191), ends).otherwise(F.lit(at))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(raw, F.lit(1), ends).cast("string"))


def occurrence_key(*parts: Column) -> Column:
    """The readable key of an occurrence; null parts are empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
