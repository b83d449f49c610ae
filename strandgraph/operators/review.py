"""Dossiers around identifiers, and bounded evidence for reviews of SPECs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import EXCERPT_BYTES, EXCERPTS_BYTES, RECORD_BYTES, REVIEW_ROOTS_MAX
from . import traverse
from .ranges import running_sum


def declaration_evidence(reached: DataFrame, declarations: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Excerpts of the declarations that name a reachable SPEC or TEST, cut to the budget of their root.

    Columns: root_id, path, name, line, end_line, role, refs, excerpt. An
    excerpt has EXCERPT_BYTES at most, all of a root EXCERPTS_BYTES; the
    budget runs down in the order of path and line, and a cut never splits a
    character, so what a cut leaves is free for the next one.
    """
    marks = annotations.filter("attached AND NOT ignored").select("path", F.col("declaration").alias("name"), F.col("declaration_line").alias("line"), "kind", F.explode("refs").alias("id"))
    hits = reached.select("root_id", "id").join(marks, "id").groupBy("root_id", "path", "name", "line").agg(F.array_sort(F.collect_set("id")).alias("refs"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    spans = declarations.select("path", "name", "line", "end_line")
    text = files.select("path", F.split("content", "\n", -1).alias("lines"))
    whole = hits.join(spans, ["path", "name", "line"]).join(text, "path")
    whole = whole.withColumn("full", F.array_join(F.slice("lines", F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")).drop("lines")
    role = F.when(F.array_contains("kinds", "test-contract"), "contract_test").when(F.array_contains("kinds", "test"), "test").otherwise("implementation")
    rows = whole.withColumn("role", role).withColumn("cut", ids.cut_bytes(F.col("full"), EXCERPT_BYTES)).drop("kinds", "full")

    def spend(group):
        left, out = EXCERPTS_BYTES, []
        for excerpt in (group := group.sort_values(["path", "line"])).cut:
            raw = excerpt.encode()[:left].decode(errors="ignore")
            left -= len(raw.encode())
            out.append(raw)
        return group.drop(columns="cut").assign(excerpt=out)

    schema = "root_id string, path string, name string, line int, refs array<string>, end_line int, role string, excerpt string"
    return rows.select("root_id", "path", "name", "line", "refs", "end_line", "role", "cut").groupBy("root_id").applyInPandas(spend, schema)


def running_budget(rows: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``emitted``: the bytes that the budget of the group leaves for each, in the order given."""
    spent = running_sum(rows, group, order, F.least(F.lit(EXCERPT_BYTES), F.col(size)))
    return spent.withColumn("emitted", F.greatest(F.lit(0), F.least(F.lit(EXCERPT_BYTES), F.col(size), EXCERPTS_BYTES - F.col("before")))).drop("before")


def canonical(found: DataFrame, records: DataFrame) -> DataFrame:
    """The authored record of each declaration occurrence (entity_id, path, line), its text bounded."""
    rows = records.select("path", "line", F.col("id").alias("entity_id"), "title", "status", "role", ids.cut_bytes(F.col("markdown"), RECORD_BYTES).alias("markdown"))
    return found.filter("kind = 'declaration'").select("entity_id", "path", "line").join(rows, ["entity_id", "path", "line"])


def dossier(spark: SparkSession, root: str, facts: dict[str, DataFrame], depth: int = 1, mentions: bool = False) -> dict[str, DataFrame]:
    """All about one id: entity, occurrences, relations, related entities, records and findings.

    An id that nothing mentions gives an ``unresolved`` entity and empty parts.
    """
    traverse.check_query(root, depth)
    roots = spark.createDataFrame([(root,)], "root_id string")
    reached, relations = traverse.trace(roots, facts["relations"], facts["entities"], depth, mentions)
    own = roots.select(F.col("root_id").alias("id")).join(facts["entities"], "id", "left")
    status = F.when((F.col("resolution") == "resolved") & (F.col("lifecycle") == "planned"), F.lit("planned")).otherwise(F.coalesce("resolution", F.lit("unresolved")))
    near = facts["occurrences"].join(reached.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    near = near if mentions else near.filter("kind <> 'mention'")
    related = reached.filter("depth > 0").join(facts["entities"], "id").select("id", "kind", "lifecycle", "resolution", "depth")
    ambiguous = own.filter("resolution = 'ambiguous'").select(F.lit("duplicate-owner").alias("rule"), "id")
    unknown = own.filter("resolution IS NULL").select(F.lit("unknown-id").alias("rule"), "id")
    undefined = own.filter("resolution = 'unresolved'").select(F.lit("undefined-reference").alias("rule"), "id")
    parts = {"entity": own.withColumn("status", status), "occurrences": near, "relations": relations, "related": related, "states": ambiguous.unionByName(unknown).unionByName(undefined)}
    if "records" in facts:
        parts["records"] = canonical(near, facts["records"])
    if "findings" in facts:
        paths = near.select(F.col("path").alias("file")).distinct()
        linked = facts["findings"].withColumn("file", ids.location_path(F.col("source")))
        parts["findings"] = linked.join(reached.select(F.col("id").alias("link")), "link", "left_semi").unionByName(linked.join(paths, "file", "left_semi").select(linked.columns)).drop("file").distinct()
    return parts


def review_roots(ids_: list[str]) -> list[str]:
    """One to ten different SPECs, in the order given."""
    unique = list(dict.fromkeys(x.strip() for x in ids_))
    if not 1 <= len(unique) <= REVIEW_ROOTS_MAX or any(not x.startswith("SPEC-") for x in unique):
        raise ValueError(f"1 to {REVIEW_ROOTS_MAX} SPECs are needed")
    return unique


def review(spark: SparkSession, specs: list[str], facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Relations, related entities, records and excerpts around several SPECs, in one traversal of depth 2.

    Refuses SPECs that are not resolved.
    """
    roots = review_roots(specs)
    frame = spark.createDataFrame([(r,) for r in roots], "root_id string")
    states = {r.id: r.resolution for r in facts["entities"].filter(F.col("id").isin(*roots)).select("id", "resolution").collect()}
    if bad := [r for r in roots if states.get(r) != "resolved"]:
        raise ValueError(f"not resolved: {', '.join(bad)}")
    reached, relations = traverse.trace(frame, facts["relations"], facts["entities"], 2)
    near = facts["occurrences"].join(reached.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    proofs = relations.filter("type = 'tests' OR type = 'verifies'").select("root_id", F.when(F.col("src").startswith("TEST-"), F.col("src")).otherwise(F.col("dst")).alias("id"))
    named = frame.select("root_id", F.col("root_id").alias("id")).union(proofs).distinct()
    return {
        "relations": relations,
        "related": reached.filter("depth > 0").join(facts["entities"], "id"),
        "records": canonical(near, facts["records"]),
        "evidence": declaration_evidence(named, facts["declarations"], facts["annotations"], facts["files"]),
    }


def completion(records: DataFrame, gaps: DataFrame, paths: DataFrame) -> DataFrame:
    """path, slots and whether a document is complete: it has no gap (findings with a field in ``code``)."""
    slots = gaps.select(ids.location_path(F.col("source")).alias("path"), F.concat_ws(".", ids.slug(F.col("link")), "code").alias("slot")).distinct()
    found = slots.groupBy("path").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    joined = paths.select("path").distinct().join(found, "path", "left")
    return joined.select("path", F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), F.col("slots").isNull().alias("complete"))
