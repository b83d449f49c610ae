"""What must be reviewed after a set of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import IMPACT_DEPTH
from .ranges import meeting
from .storage import cut
from .traverse import _both_ways, idle_ends, without_ends

REASON = "struct<kind: string, path: string, line: int, source_id: string, relation: string, record_id: string, field: string, conservative: boolean>"


def normalised_changes(changes: DataFrame) -> DataFrame:
    """One change a path, the last by ``seq``; later ones win."""
    last = changes.groupBy("path").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "path"]), "seq").alias("l"))
    return last.select("path", "l.*")


def indexed_changes(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """Changes with the ids that the index knows, or all of a deleted file: path, status, id."""
    each = changes.select("path", "status", F.explode("annotation_ids").alias("id"))
    known = entities.select("id", F.lit(True).alias("known"))
    return each.join(known, "id", "left").filter(F.col("known") | (F.col("status") == "deleted")).select("path", "status", "id")


def touched_spans(spans: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (line, end_line) that a hunk (new_start, new_lines) with the same keys meets; empty hunks meet none."""
    used = hunks.filter("new_lines > 0").select(*keys, F.col("new_start").alias("first"), (F.col("new_start") + F.col("new_lines") - 1).alias("last"))
    return meeting(spans, used, keys)


def _reason(kind: str, **parts: Column) -> Column:
    none = F.lit(None)
    fields = ("path", "line", "source_id", "relation", "record_id", "field")
    made = [F.lit(kind).alias("kind"), *[parts.get(f, none).cast("int" if f == "line" else "string").alias(f) for f in fields], parts.get("conservative", F.lit(False)).alias("conservative")]
    return F.struct(*made)


def seeds(changes: DataFrame, hunks: DataFrame, occurrences: DataFrame, entities: DataFrame, declarations: DataFrame, annotations: DataFrame) -> DataFrame:
    """id, reason and evidence: changed ids, ids of changed declarations, else all occurrences of a changed file."""
    ids = indexed_changes(changes, entities).select("id", _reason("changed_annotation", path=F.col("path")).alias("reason"), F.lit(True).alias("evidence"))
    bound = annotations.filter("attached AND NOT ignored").select("path", F.col("declaration").alias("name"), F.col("declaration_line").alias("line"), F.explode("refs").alias("id"))
    hit = touched_spans(declarations.select("path", "name", "line", "end_line"), hunks, ["path"]).join(bound, ["path", "name", "line"])
    exact = hit.select("id", _reason("changed_declaration", path=F.col("path"), line=F.col("line")).alias("reason"), F.lit(True).alias("evidence"))
    rest = changes.select("path").distinct().join(hit.select("path").distinct(), "path", "left_anti")
    analysed = declarations.select("path").distinct().withColumn("analysed", F.lit(True))
    proof = F.col("kind").isin("implementation", "test_evidence")
    wide = occurrences.join(rest, "path").join(analysed, "path", "left")
    wide = wide.select(
        F.col("entity_id").alias("id"),
        _reason("changed_occurrence", path=F.col("path"), line=F.col("line"), record_id=F.col("record_id"), field=F.col("field"), conservative=F.coalesce("analysed", F.lit(False)) & proof).alias("reason"),
        proof.alias("evidence"),
    )
    return ids.unionByName(exact).unionByName(wide)


#: Levels of a queue that stay in one plan.
LEVELS_IN_ONE = 2


def queue(start: DataFrame, relations: DataFrame, entities: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """id, kind, lifecycle, resolution, distance and reasons of everything within reach of the seeds (id, reason).

    Reasons also gather on ids reached before. Endpoints that are no entity
    are skipped; unknown public ids among the seeds stay as ``unknown``. Up to
    LEVELS_IN_ONE levels are one plan, where equal shuffles are made once, and
    columns that nobody asks for are never shuffled; the ids of the seeds and
    of each further frontier are written.
    """
    idle = idle_ends(relations, entities.select("id").union(start.select("id")))
    ways = without_ends(without_ends(_both_ways(relations), "from_id", idle), "to_id", idle)
    known = entities.select("id")
    levels, reasons = [cut(start.select("id").distinct())], start.select("id", "reason")
    for level in range(depth):
        steps = levels[-1].select(F.col("id").alias("from_id")).join(ways, "from_id").withColumnRenamed("to_id", "id")
        why = _reason("related_entity", path=F.col("path"), line=F.col("line"), source_id=F.col("from_id"), relation=F.col("type"), record_id=F.col("record_id"), field=F.col("field"))
        reasons = reasons.unionByName(steps.select("id", why.alias("reason")))
        new = steps.select("id").distinct().join(known, "id", "left_semi")
        for before in levels:
            new = new.join(before, "id", "left_anti")
        levels.append(new if level < LEVELS_IN_ONE else cut(new))
    distance = levels[0].withColumn("distance", F.lit(0))
    for level, ids in enumerate(levels[1:], 1):
        distance = distance.unionByName(ids.withColumn("distance", F.lit(level)))
    gathered = reasons.groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    # every id has a reason; by a left join, reasons that nobody asks for are not gathered
    joined = distance.join(gathered, "id", "left").join(entities, "id", "left")
    public = F.col("id").rlike("^(SPEC-|TEST-|contract:|component:)")
    kind = F.coalesce("kind", F.lit("unknown"))
    kept = joined.filter(F.col("kind").isin("spec", "test", "contract", "component") | (F.col("resolution").isNull() & public))
    return kept.select("id", kind.alias("kind"), "lifecycle", F.coalesce("resolution", F.lit("unresolved")).alias("resolution"), "distance", "reasons", F.col("owner.path").alias("owner_path"), F.col("owner.line").alias("owner_line"))


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "spec", 0).when(kind == "test", 1).when(kind == "contract", 2).when(kind == "component", 3).otherwise(4)


def evidence_paths(start: DataFrame) -> DataFrame:
    """The paths of all evidence that changed, as rows; every warning of ``unchanged_specs`` is about all of them."""
    return start.filter("evidence AND reason.path IS NOT NULL").select(F.col("reason.path").alias("evidence_path")).distinct()


def unchanged_specs(items: DataFrame, changes: DataFrame, start: DataFrame) -> DataFrame:
    """Queued SPECs whose own file did not change while evidence did: id and path; none if no evidence changed."""
    paths = changes.select("path").union(changes.filter("old_path IS NOT NULL").select("old_path")).distinct()
    quiet = items.filter("kind = 'spec' AND owner_path IS NOT NULL").join(paths.withColumnRenamed("path", "owner_path"), "owner_path", "left_anti")
    any_ = evidence_paths(start).limit(1).select(F.lit(True).alias("_any"))
    return quiet.select("id", F.col("owner_path").alias("path"), F.lit(True).alias("_any")).join(any_, "_any", "left_semi").drop("_any")
