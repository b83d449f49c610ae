"""Identifier bags, graph facts, entities, relations and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..schemas import REVERSE_LINKS


def observed() -> list[Column]:
    """The total order of observations of an identifier; documents before code."""
    first = F.when(F.col("origin") == "doc", 0).otherwise(1)
    return [first, *[F.col(c).asc_nulls_first() for c in ("source", "line", "seq")]]


def reverse_of(link: Column) -> Column:
    pairs = [F.lit(x) for pair in REVERSE_LINKS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), link), link)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The bag of both."""
    return first.unionByName(second, allowMissingColumns=True)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order``."""
    return first_by(rows, keys, [F.col(c).desc() for c in order])


def merge_checked(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key: its values if all its rows have the same, else nulls; ``rows`` in number, and ``conflict``.

    Two ends of an order tell whether values differ, so no group is collected;
    nulls are values like any other.
    """
    value = F.struct(*values)
    met = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("rows"))
    conflict = ~F.col("_low").eqNullSafe(F.col("_high"))
    return met.select(*keys, *[F.when(~conflict, F.col("_low")[v]).alias(v) for v in values], "rows", conflict.alias("conflict"))


def merged_writes(existing: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans to write files (path, new, data) of both sets, one for each path, and the paths for which they disagree.

    Paths are compared without ``.`` and doubled separators. Equal plans are one.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "/(\\.?/)+", "/"), r"^(\./)+", ""), "/$", "")
    whole = merge_checked(existing.unionByName(more).withColumn("path", clean), ["path"], ["new", "data"])
    return whole.filter("NOT conflict").select("path", "new", "data"), whole.filter("conflict").select("path")


def all_identifiers(identifiers: DataFrame) -> DataFrame:
    """The first observation of each id."""
    return first_by(identifiers, ["id"], observed())


def by_origin(identifiers: DataFrame, origin: str) -> DataFrame:
    return identifiers.filter(F.col("origin") == origin)


def duplicate_owners(identifiers: DataFrame) -> DataFrame:
    """id, owners and n of every id that several documents own."""
    owners = F.array_sort(F.collect_list(F.struct("source", "line")))
    return by_origin(identifiers, "doc").groupBy("id").agg(F.count("*").alias("n"), owners.alias("owners")).filter("n > 1")


def duplicates_across_directories(identifiers: DataFrame) -> DataFrame:
    """The first observation a directory of every id that several directories hold."""
    placed = identifiers.withColumn("directory", F.regexp_extract("source", "^(.*?)/?[^/]*$", 1))
    first = first_by(placed, ["id", "directory"], observed())
    many = first.groupBy("id").count().filter("count > 1").select("id")
    return first.join(many, "id", "left_semi")


def nodes(identifiers: DataFrame) -> DataFrame:
    """One row an id: attributes folded, the first or the last observation winning."""
    key = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in (F.when(F.col("origin") == "doc", 0).otherwise(1), "source", "line", "seq")])
    doc, code = F.col("origin") == "doc", F.col("origin") == "code"
    first = lambda c, when=None: F.min_by(c, F.when(F.col(c).isNotNull() & (F.lit(True) if when is None else when), key)).alias(c)
    last = lambda c, name: F.max_by(c, F.when(doc & F.col(c).isNotNull(), key)).alias(name)
    return identifiers.groupBy("id").agg(
        first("type"),
        F.coalesce(F.bool_or(doc), F.lit(False)).alias("has_doc"),
        F.coalesce(F.bool_or(code), F.lit(False)).alias("has_code"),
        last("kind", "kind_doc"),
        F.coalesce(F.bool_or(code & (F.col("kind") == "contract")), F.lit(False)).alias("kind_code_contract"),
        F.coalesce(F.bool_or(code & (F.col("kind") == "behavior")), F.lit(False)).alias("kind_code_test"),
        last("status", "status"),
        last("namespace", "namespace"),
        last("document_role", "document_role"),
        F.coalesce(F.bool_or("derived"), F.lit(False)).alias("derived"),
        F.min_by("title", F.when(F.col("title").isNotNull(), key)).alias("display_name"),
        F.min_by("source", F.when(doc, key)).alias("source_doc"),
        F.min_by("source", F.when(code, key)).alias("source_code"),
        F.min_by("source", key).alias("source_file"),
    )


def edges(identifiers: DataFrame, node_types: DataFrame) -> DataFrame:
    """All links, typed or inferred, each with ``verified``: its reverse exists and starts at a node."""
    typed = identifiers.select("id", F.explode("typed_links").alias("l")).select(F.col("id").alias("src"), F.col("l.ref").alias("dst"), F.col("l.type").alias("type"), F.col("l.source").alias("source"), F.col("l.line").alias("line"))
    plain = identifiers.select("id", "type", "source", "line", F.explode("links").alias("dst"))
    known = node_types.select(F.col("id").alias("dst"), F.col("type").alias("to_type"))
    plain = plain.join(known, "dst", "left").withColumn("to_type", F.coalesce("to_type", ids.type_of(F.col("dst"))))
    plain = plain.select(F.col("id").alias("src"), "dst", ids.graph_link_type(F.col("type"), F.col("to_type")).alias("type"), "source", "line")
    return verified(typed.unionByName(plain), node_types)


def verified(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links`` (src, dst, type, ...) with ``verified``."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), reverse_of(F.col("type")).alias("type")).distinct().withColumn("back", F.lit(True))
    starts = known.select(F.col("id").alias("src"), F.lit(True).alias("known")).distinct()
    joined = links.join(back, ["src", "dst", "type"], "left").join(starts, "src", "left")
    return joined.withColumn("verified", F.coalesce(F.col("back") & F.col("known"), F.lit(False))).drop("back", "known")


def outbound(links: DataFrame, known: DataFrame, link_type: str) -> DataFrame:
    """Links of a type that start at a known node."""
    return links.filter(F.col("type") == link_type).join(known.select(F.col("id").alias("src")), "src", "left_semi")


def inbound(links: DataFrame, known: DataFrame, link_type: str) -> DataFrame:
    return links.filter(F.col("type") == link_type).join(known.select(F.col("id").alias("dst")), "dst", "left_semi")


def backlinks(links: DataFrame, target: str) -> DataFrame:
    return links.filter(F.col("dst") == target).select("src")


def degrees(known: DataFrame, links: DataFrame) -> DataFrame:
    """id, in_degree and out_degree of every node, none left out."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    joined = known.select("id").distinct().join(sums, "id", "left")
    return joined.select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def statistics(known: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges and the nodes of each type."""
    by_type = [F.count_if(F.col("type") == t).alias(f"{t.lower()}s") for t in ids.TYPES]
    return known.agg(F.count("*").alias("nodes"), *by_type).crossJoin(links.agg(F.count("*").alias("edges")))


def evidence_kind(identifier_type: Column, origin: Column) -> Column:
    """What an observation is: a declaration in a document, or evidence in code."""
    return F.when(origin == "doc", F.lit("declaration")).when(identifier_type == "TEST", F.lit("test_evidence")).otherwise(F.lit("implementation"))


def with_occurrence_ids(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """``rows`` with ``id``: the readable key, and ``#n`` from the second of equal keys on; ``dealt`` as in ``occurrences``."""
    base = ids.occurrence_key(*[F.col(c) for c in ("entity_id", "path", "line", "kind", "field", "record_id")])
    ordered = rows.withColumn("_base", base)
    order = W.partitionBy(*["entity_id"] * dealt, "_base").orderBy(*[c for c in ("seq", "title", "description") if c in rows.columns])
    ordered = ordered.withColumn("_n", F.row_number().over(order))
    return ordered.withColumn("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("#", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def occurrences(identifiers: DataFrame, mentions: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Declarations, evidence and references, and the ``mentions`` (entity_id, path, line) given.

    With ``dealt``, rows are dealt by entity_id once and stay so, for what
    gathers them by id anyway; ids must not hold the ``|`` of keys then.
    """
    code = F.when(F.col("type") == "TEST", F.lit("test")).otherwise(F.lit("source"))
    own = identifiers.select(
        F.col("id").alias("entity_id"),
        F.when(F.col("origin") == "doc", F.lit("doc")).otherwise(code).alias("origin"),
        "document_role",
        evidence_kind(F.col("type"), F.col("origin")).alias("kind"),
        F.col("source").alias("path"),
        "line",
        F.lit(None).cast("string").alias("field"),
        F.when(F.col("origin") == "doc", F.col("id")).alias("record_id"),
        "title",
        F.col("describe").alias("description"),
        "seq",
    )
    refs = _links(identifiers).select(
        F.col("dst").alias("entity_id"), "origin", "document_role", F.lit("reference").alias("kind"), "path", "line", "field", "record_id",
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), "seq",
    )
    found = own.unionByName(refs)
    if mentions is not None:
        extra = mentions.select("entity_id", "path", "line").withColumns({"origin": F.lit("doc"), "kind": F.lit("mention"), "seq": F.lit(0).cast("long")})
        found = found.unionByName(extra, allowMissingColumns=True)
    return with_occurrence_ids(found.repartition("entity_id") if dealt else found, dealt)


def _links(identifiers: DataFrame) -> DataFrame:
    base = identifiers.select("id", "type", "origin", "document_role", "source", "line", "seq", "links", "typed_links")
    typed = base.select("id", "type", "origin", "document_role", "seq", F.col("source").alias("own"), F.posexplode("typed_links").alias("pos", "l")).select(
        "id", "type", "origin", "document_role", "seq", "pos", F.col("l.ref").alias("dst"), F.col("l.type").alias("link"),
        F.coalesce("l.source", "own").alias("path"), F.col("l.line").alias("line"), F.col("l.field").alias("field"), F.coalesce("l.record_id", "id").alias("record_id"),
    )
    plain = base.select("id", "type", "origin", "document_role", "seq", F.col("source").alias("path"), "line", F.posexplode("links").alias("pos", "dst"))
    plain = plain.withColumn("link", ids.trace_link_type(F.col("type"), F.col("dst"))).withColumns({"field": F.lit(None).cast("string"), "record_id": F.col("id")})
    found = typed.unionByName(plain.select(typed.columns))
    found = found.withColumn("relation", ids.relation_type(F.col("type"), F.col("dst"), F.col("link")))
    return found.withColumn("field", F.coalesce("field", ids.relation_field(F.col("relation"))))


def relations(identifiers: DataFrame) -> DataFrame:
    """Typed directed relations with the place they are written at; code evidence gives ``implements`` or ``executes``."""
    links = _links(identifiers).select(F.col("id").alias("src"), "dst", F.col("relation").alias("type"), F.lit("reference").alias("occurrence_kind"), "path", "line", "field", "record_id")
    kind = evidence_kind(F.col("type"), F.col("origin"))
    evidence = identifiers.filter(F.col("origin") == "code").select(
        F.concat_ws(":", "source", F.col("line").cast("string")).alias("src"),
        F.col("id").alias("dst"),
        F.when(F.col("type") == "TEST", F.lit("executes")).otherwise(F.lit("implements")).alias("type"),
        kind.alias("occurrence_kind"),
        F.col("source").alias("path"),
        "line",
        F.lit("annotation").alias("field"),
        F.lit(None).cast("string").alias("record_id"),
    )
    return links.unionByName(evidence)


def entities(found: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row for every id that occurs: kind, namespace, lifecycle, resolution, owner and owners."""
    known = found.groupBy(F.col("entity_id").alias("id")).agg(
        F.count_if(F.col("kind") == "declaration").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "declaration", F.struct("path", "line")))).alias("owners"),
    )
    key = F.struct("source", "line", "seq")
    authored = identifiers.filter("origin = 'doc'").groupBy("id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), key)).alias("status"), F.max_by("namespace", F.when(F.col("namespace").isNotNull(), key)).alias("authored")
    )
    joined = known.join(authored, "id", "left")
    resolution = resolution_of(F.col("n"))
    return joined.select(
        "id",
        ids.kind_of(F.col("id")).alias("kind"),
        F.coalesce(F.nullif(ids.namespace_of(F.col("id")), F.lit("")), "authored").alias("namespace"),
        F.coalesce("status", F.when(F.col("n") == 1, F.lit("active"))).alias("lifecycle"),
        resolution.alias("resolution"),
        F.when(F.col("n") == 1, F.col("owners")[0]).alias("owner"),
        "owners",
    )


def resolution_of(owners: Column) -> Column:
    return F.when(owners == 0, F.lit("unresolved")).when(owners == 1, F.lit("resolved")).otherwise(F.lit("ambiguous"))


def occurrences_in(found: DataFrame, path: str, first: int = 0, last: int = 0) -> DataFrame:
    """Occurrences in a file between two lines; a bound of 0 or less is open."""
    chosen = found.filter(F.col("path") == path)
    chosen = chosen.filter(F.col("line") >= first) if first > 0 else chosen
    return chosen.filter(F.col("line") <= last) if last > 0 else chosen


def plain_mentions(mentions: DataFrame, found: DataFrame) -> DataFrame:
    """Mentions on lines where the id has no structured occurrence."""
    return mentions.join(found.select("entity_id", "path", "line"), ["entity_id", "path", "line"], "left_anti")


def sorted_occurrences(found: DataFrame) -> DataFrame:
    return found.orderBy("kind", "path", "line", "field", "id")


def sorted_relations(found: DataFrame) -> DataFrame:
    return found.orderBy("type", "src", "dst", "path", "line", "field")
