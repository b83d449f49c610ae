"""``python -m strandgraph COMMAND PATH``: validate, trace, review, impacted and status of a project."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import render, report, traverse
from .operators.review import review_roots
from .project import Project
from .sources.config import discover


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strandgraph", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("validate", "all findings"), ("trace", "one identifier and what lies around it"), ("review", "bounded evidence of SPECs"), ("impacted", "what changes since a revision make worth a review"), ("status", "what documents still need")):
        sub = commands.add_parser(name, help=words)
        sub.add_argument("path", help="root of the project")
        sub.add_argument("--config", help="configuration file")
        sub.add_argument("--format", choices=("json", "markdown"), default="json")
        if name == "trace":
            sub.add_argument("id")
            sub.add_argument("--depth", type=int, default=1)
            sub.add_argument("--mentions", action="store_true")
        if name == "review":
            sub.add_argument("ids", nargs="+")
        if name == "impacted":
            sub.add_argument("--base", required=True)
        if name == "status":
            sub.add_argument("--target", default=".")
    return parser.parse_args(given)


def run(spark: SparkSession, given: argparse.Namespace) -> tuple[str, int]:
    """The text of a command, and its exit status: 1 for errors, unresolved or ambiguous ids, and incomplete documents."""
    root = os.path.abspath(given.path)
    if given.command == "trace":
        traverse.check_query(given.id, given.depth)
    if given.command == "review":
        review_roots(given.ids)
    project, plain = Project(spark, root, discover(root, given.config)), given.format == "markdown"
    if given.command == "validate":
        found = project.validate()
        text = report.as_markdown(found) if plain else report.as_json(found)
        return text, int(not report.totals(found).first()["valid"])
    if given.command == "trace":
        facts = {**project.facts, "findings": project.validate()}
        row = render.dossiers(spark.createDataFrame([(given.id,)], "root_id string"), facts, given.depth, given.mentions).first()
        return render.dossier_text(row["json"]) if plain else row["json"], int(row["status"] in ("unresolved", "ambiguous"))
    if given.command == "review":
        rows = render.reviews(spark, given.ids, project.facts).withColumnRenamed("ordinal", "ord").drop("root_id")
        return render.document(rows, {"schema": render.REVIEWS, "requested_spec_ids": review_roots(given.ids)}, "contexts"), 0
    if given.command == "impacted":
        changes, items, warnings, start = project.impact_parts(given.base)
        return render.document(render.impact_rows(changes, items, warnings, start), {"schema": render.IMPACT, "base": given.base}), 0
    slots = project.slots(given.target)
    if plain:
        text = render.status_text(slots)
    else:
        text = render.document(render.status_rows(slots), {"schema": render.STATUS, "targets": [given.target], "incomplete_slots": []}, "incomplete_slots")
    return text, int(not slots.isEmpty())


def main(given: list[str] | None = None) -> int:
    asked = arguments(given)
    spark = SparkSession.builder.appName("strandgraph").getOrCreate()
    text, status = run(spark, asked)
    sys.stdout.write(text if text.endswith("\n") else text + "\n")
    return status


if __name__ == "__main__":
    sys.exit(main())
