"""Findings as reports: totals, top rules, groups, and their text forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ids
from ..schemas import TOP_RULES
from . import graph


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule", "message", "source", "link", "code")


def totals(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the project is valid."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("valid"))


def top_rules(findings: DataFrame, n: int = TOP_RULES) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(n)


def located(findings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Findings with file, line, title, the primary identifier, and the ids that ``edges`` relate to it."""
    rows = findings.withColumns(
        {
            "file": F.nullif(ids.location_path(F.col("source")), F.lit("")),
            "line": ids.location_line(F.col("source")),
            "rule_title": ids.humanise(F.col("rule")),
            "primary_id": ids.report_identifier(F.col("link"), F.col("message"), F.col("code"), F.col("source")),
        }
    )
    if edges is None:
        return rows.withColumn("related", F.array().cast("array<string>"))
    ends = edges.select(F.col("src").alias("primary_id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    related = ends.groupBy("primary_id").agg(F.array_sort(F.collect_set("other")).alias("related"))
    return rows.join(related, "primary_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def grouped(rows: DataFrame) -> DataFrame:
    """Groups by severity and rule of ``located`` findings: n, files, identifiers and the 1-based numbers of their findings.

    Numbers follow the order of the whole list, which the rule leads: a rule's
    findings are numbered in a window of their own and shifted by the rules
    before it, so no task holds all findings.
    """
    order = ["message", "source", "link", "code", "severity"]
    sizes = rows.groupBy("rule").count()
    starts = sizes.select("rule", F.coalesce(F.sum("count").over(W.orderBy("rule").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = rows.withColumn("own", F.row_number().over(W.partitionBy("rule").orderBy(*order))).join(F.broadcast(starts), "rule")
    numbered = numbered.withColumn("number", (F.col("start") + F.col("own")).cast("long"))
    each = F.concat(F.filter(F.array("primary_id"), lambda x: x.isNotNull()), "related")
    return numbered.groupBy("severity", "rule").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set("file")).alias("files"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(each)))).alias("identifiers"),
        F.array_sort(F.collect_list("number")).alias("findings"),
    )


def snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with degrees, and edges with ``verified``."""
    return nodes.select("id", "type").join(graph.degrees(nodes, edges), "id"), edges.select("src", "dst", "type", "verified")


def as_json(findings: DataFrame, schema: str = "trace.report.v1") -> str:
    """The report as one JSON document, read partition by partition; ``write`` is for reports that a driver does not hold."""
    rows = (r.asDict() for r in ordered(findings).toLocalIterator())
    sums = totals(findings).first().asDict()
    return json.dumps({"schema": schema, **sums, "findings": [{k: v for k, v in r.items() if v is not None} for r in rows]}, indent=2, ensure_ascii=False)


def as_markdown(findings: DataFrame, repair: bool = False) -> str:
    """The report as Markdown; with ``repair`` by groups, with what to do."""
    sums = totals(findings).first()
    out = ["# Traceability report", "", f"- Status: {'valid' if sums.valid else 'invalid'}", f"- Errors: {sums.errors}", f"- Warnings: {sums.warnings}", ""]
    out += ["## Most frequent rules", "", *[f"- {r.rule}: {r.n}" for r in top_rules(findings).collect()], "", "## Findings", ""]
    last = None
    for r in ordered(findings).toLocalIterator():
        if repair and r.rule != last:
            out += [f"### {r.rule}", ""]
            last = r.rule
        out.append(f"- [{r.severity}] {'' if repair else r.rule + ': '}{r.message}" + (f" ({r.source})" if r.source else ""))
    return "\n".join(out) + "\n"


def write(findings: DataFrame, path: str) -> None:
    """The findings as JSON lines, written by the executors."""
    findings.write.mode("overwrite").json(path)
