"""Dossiers, reviews, impact and completion as JSON, a row for each document or part, and as text for few rows.

All lists are sorted by every field that tells their items apart, so the same
facts give the same text. A null or empty field is left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import review, traverse
from .impact import evidence_paths, kind_rank

# Names of the forms.
TRACE, REVIEW, REVIEWS, IMPACT, STATUS = "trace.v1", "spec_review_context.v2", "spec_review_context_batch.v2", "impacted.v1", "document_status.v1"

#: Fields of an item, in the order by which a list of them is sorted.
OCCURRENCE = ("kind", "entity_id", "path", "line", "field", "record_id", "id", "origin", "document_role")
RELATION = ("type", "src", "dst", "path", "line", "field", "record_id", "occurrence_id", "occurrence_kind", "depth")
RELATED = ("depth", "id", "kind", "lifecycle", "resolution")
EVIDENCE = ("path", "line", "name", "end_line", "role", "refs", "excerpt")
FINDING = ("rule", "source", "message", "severity", "link", "code")
SLOT = ("path", "line", "slot", "role", "reason")


def item(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """A struct of those fields that ``rows`` has; nulls of text are empty, so that order has no gaps."""
    kinds = dict(rows.dtypes)
    return F.struct(*[(F.coalesce(F.col(f), F.lit("")) if kinds[f] == "string" else F.col(f)).alias(f) for f in fields if f in kinds])


def shown(items: Column, rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """Sorted items without their empty fields."""
    kinds = dict(rows.dtypes)
    return F.transform(F.array_sort(items), lambda x: F.struct(*[(F.nullif(x[f], F.lit("")) if kinds[f] == "string" else x[f]).alias(f) for f in fields if f in kinds]))


def listed(rows: DataFrame, key: str, names: dict[str, str], fields: tuple[str, ...]) -> DataFrame:
    """key and the sorted lists of its items, one for each name, of the rows that its condition holds for."""
    made = item(rows, fields)
    lists = [F.collect_list(F.when(F.expr(condition), made)).alias(f"_{name}") for name, condition in names.items()]
    return rows.groupBy(key).agg(*lists).select(key, *[shown(F.col(f"_{name}"), rows, fields).alias(name) for name in names])


def _joined(heads: DataFrame, key: str, parts: list[tuple[dict[str, str], DataFrame, tuple[str, ...]]]) -> DataFrame:
    """``heads`` with the lists of each part (names and conditions, rows, fields), empty where a key has none."""
    for names, rows, fields in parts:
        found = listed(rows, key, names, fields)
        heads = heads.join(found, key, "left").withColumns({name: F.coalesce(name, F.array().cast(found.schema[name].dataType)) for name in names})
    return heads


def dossiers(roots: DataFrame, facts: dict[str, DataFrame], depth: int = 1, mentions: bool = False) -> DataFrame:
    """root_id, status and json of the dossier of each root (root_id); an unknown id has an empty one.

    Owners and occurrences are those of the id itself, relations and related
    entities what the traversal finds. A dossier is one document, so what is
    around one id meets in one row.
    """
    reached, relations = traverse.trace(roots, facts["relations"], facts["entities"], depth, mentions, ("kind", "lifecycle", "resolution"))
    entities = facts["entities"].withColumnRenamed("id", "root_id")
    own = facts["occurrences"].join(roots.select(F.col("root_id").alias("entity_id")).distinct(), "entity_id", "left_semi").withColumn("root_id", F.col("entity_id"))
    plain = own.filter("kind <> 'mention'")
    related = reached.filter("depth > 0")
    status = F.when((F.col("resolution") == "resolved") & (F.col("lifecycle") == "planned"), "planned").otherwise(F.coalesce("resolution", F.lit("unresolved")))
    entity = F.when(F.col("resolution").isNotNull(), F.struct(F.col("root_id").alias("id"), F.nullif("kind", F.lit("")).alias("kind"), F.nullif("namespace", F.lit("")).alias("namespace"), F.nullif("lifecycle", F.lit("")).alias("lifecycle"), "resolution"))
    kept = ["root_id", "kind", "namespace", "lifecycle", "resolution"]
    heads = roots.select("root_id").distinct().join(entities.select(*kept), "root_id", "left").select("root_id", status.alias("status"), entity.alias("entity"))
    parts = [
        ({"owners": "kind = 'declaration'", "occurrences": "true"}, plain, OCCURRENCE),
        ({"outbound_relations": "direction = 'outbound'", "inbound_relations": "direction = 'inbound'"}, relations, RELATION),
        ({"related_entities": "true"}, related, RELATED),
    ]
    parts += [({"mentions": "true"}, own.filter("kind = 'mention'"), OCCURRENCE)] if mentions else []
    if "findings" in facts:
        near = reached.select("root_id", F.col("id").alias("link"))
        places = plain.select("root_id", F.col("path").alias("file")).distinct()
        told = facts["findings"].withColumn("file", F.regexp_extract("source", r"^(.*?)(?::(\d+))?$", 1))
        both = told.join(near, "link").select("root_id", *FINDING).unionByName(told.join(places, "file").select("root_id", *FINDING)).distinct()
        parts.append(({"findings": "true"}, both, FINDING))
    whole = _joined(heads, "root_id", parts)
    query = F.struct(F.col("root_id").alias("id"), F.lit(depth).alias("depth"))
    return whole.select("root_id", "status", F.to_json(F.struct(F.lit(TRACE).alias("schema"), query.alias("query"), *[c for c in whole.columns if c != "root_id"])).alias("json"))


def reviews(spark, specs: list[str], facts: dict[str, DataFrame]) -> DataFrame:
    """root_id, ordinal and json of the review context of each SPEC, in the order asked for."""
    parts = review.review(spark, specs, facts)
    order = spark.createDataFrame(list(enumerate(review.review_roots(specs))), "ordinal int, root_id string")
    whole = _joined(order, "root_id", [({"related": "true"}, parts["related"], RELATED), ({"relations": "true"}, parts["relations"], RELATION), ({"evidence": "true"}, parts["evidence"], EVIDENCE)])
    return whole.select("root_id", "ordinal", F.to_json(F.struct(F.lit(REVIEW).alias("schema"), F.col("root_id").alias("spec_id"), "related", "relations", "evidence")).alias("json"))


def impact_rows(changes: DataFrame, items: DataFrame, warnings: DataFrame, start: DataFrame) -> DataFrame:
    """part, ord and json of each change, queued item, warning and evidence path of an impact report, so that a long queue stays rows."""
    change = changes.select(F.lit("changes").alias("part"), F.col("path").alias("ord"), F.to_json(F.struct("path", F.nullif("old_path", F.lit("")).alias("old_path"), "status", F.array_sort("annotation_ids").alias("annotation_ids"))).alias("json"))
    place = F.when(F.col("owner_path").isNotNull(), F.struct(F.col("owner_path").alias("path"), F.col("owner_line").alias("line")))
    queue = items.select(F.lit("queue"), F.concat(kind_rank(F.col("kind")).cast("string"), "id"), F.to_json(F.struct("id", "kind", "lifecycle", "resolution", place.alias("canonical"), "reasons")))
    told = warnings.select(F.lit("warnings"), "id", F.to_json(F.struct(F.lit("related-spec-unchanged").alias("rule"), F.col("id").alias("entity"), "path")))
    paths = evidence_paths(start).select(F.lit("evidence_paths"), "evidence_path", F.to_json(F.struct(F.col("evidence_path").alias("path"))))
    return change.union(queue).union(told).union(paths)


def status_rows(slots: DataFrame) -> DataFrame:
    """path, ord and json of each incomplete slot."""
    shape = F.struct(F.col("path").alias("file"), "line", "role", "slot", "reason")
    return slots.select("path", F.concat(F.lpad(F.col("line").cast("string"), 10, "0"), F.lit(" "), "slot").alias("ord"), F.to_json(shape).alias("json"))


def document(rows: DataFrame, head: dict, part: str | None = None) -> str:
    """One JSON text of few rows (ord, json, and part for several lists), in their order; for a caller who wants a file."""
    found = dict(head)
    for r in rows.orderBy(*(["part"] if "part" in rows.columns else ["path"] if "path" in rows.columns else []), "ord").collect():
        found.setdefault(r["part"] if "part" in rows.columns else part, []).append(json.loads(r["json"]))
    return json.dumps(found, indent=2) + "\n"


def dossier_text(body: str) -> str:
    """A dossier (json) as Markdown."""
    found = json.loads(body)
    out = [f"# {found['query']['id']}", "", f"Status: `{found['status']}`", ""]
    for name in ("owners", "occurrences", "outbound_relations", "inbound_relations", "related_entities", "mentions", "findings"):
        if found.get(name):
            out += [f"## {name.replace('_', ' ').capitalize()}", ""]
            for x in found[name]:
                place = f" ({x['path']}:{x.get('line', 0)})" if "path" in x else ""
                said = f"{x['src']} {x['type']} {x['dst']}" if "src" in x else x.get("message") or " ".join(str(x[k]) for k in ("kind", "id") if k in x)
                out.append(f"- {said}{place}")
            out.append("")
    return "\n".join(out)


def status_text(slots: DataFrame) -> str:
    """The incomplete slots, a line each; for few of them."""
    rows = slots.orderBy("path", "line", "slot").collect()
    return "\n".join(f"{r['path']}:{r['line']} [{r['slot']}] {r['reason']}" for r in rows) or "All required document slots are complete."
