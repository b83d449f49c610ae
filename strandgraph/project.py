"""A project of Markdown records and source files: validate, trace, review and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dialects
from .operators import graph, impact, older, review, rules, slots
from .operators.storage import cut
from .sources import code, git, markdown
from .sources.config import Config, discover


class Project:
    """The facts of a project, each read once and kept for all its queries."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None) -> None:
        self.spark, self.root, self.config = spark, root, config or discover(root)
        docs = cut(markdown.files(spark, f"file://{root}", "*.md", self.config.docs_ignore))
        sources = markdown.files(spark, f"file://{root}", "*.{%s}" % ",".join(code.LANGUAGES), self.config.ignore)
        sources = cut(sources.filter(dialects.matches(F.col("path"), self.config.code_patterns, "sources")))
        records = cut(markdown.records(docs))
        parsed = cut(code.parsed(sources, self.config.annotations))
        declarations, annotations = code.declarations(parsed), cut(code.annotations(parsed))
        old_lines = cut(older.lines(docs))
        modes = cut(older.modes(old_lines, older.front_matter(docs)))
        former = docs.join(modes.filter("NOT in_set AND NOT identity").select("path"), "path", "left_semi")
        observed, self._older = older.collect(former)
        observed = cut(older.observations(observed))
        declared = markdown.identifiers(records)
        identifiers = cut(graph.merge(graph.merge(declared, observed), code.identifiers(annotations)))
        narrated = older.narratives(old_lines, modes, identifiers.filter("origin = 'doc'").join(observed, "id", "left_anti").select("id"), observed.select("id", F.col("source").alias("path")))
        self._older = self._older.unionByName(narrated)
        nodes = cut(graph.nodes(identifiers))
        mentions = graph.plain_mentions(markdown.mentions(docs), graph.occurrences(identifiers))
        occurrences = cut(graph.occurrences(identifiers, mentions))
        self.facts: dict[str, DataFrame] = {
            "files": sources, "records": records, "lines": cut(markdown.lines(docs)), "paths": docs.select("path"), "declarations": declarations,
            "annotations": annotations, "errors": code.parse_errors(parsed), "raw": markdown.raw_lines(docs.filter(dialects.matches(F.col("path"), self.config.doc_patterns, "visited") & ~dialects.matches(F.col("path"), self.config.ignore, "parts"))),
            "old_lines": old_lines, "modes": modes, "text_findings": markdown.findings(docs), "identifiers": identifiers,
            "nodes": nodes, "edges": cut(graph.edges(identifiers, nodes)), "occurrences": occurrences, "relations": cut(graph.relations(identifiers)),
            "entities": cut(graph.entities(occurrences, identifiers)),
        }
        self._findings: DataFrame | None = None

    def validate(self) -> DataFrame:
        """All findings, found once."""
        if self._findings is None:
            found = rules.validate(self.spark, self.facts, self.config.switches)
            units = [(u.package, u.patterns) for u in self.config.units]
            sources = self.facts["files"].select("path")
            found = found.unionByName(rules.unit_mapping(sources, units)).unionByName(rules.unmirrored_docs(self.facts["paths"], sources, units, self.config.docs_ignore))
            found = found.unionByName(self._older)
            if self.config.switches.get("related_files", True):
                visited = self.facts["raw"].select("path").distinct()
                found = found.unionByName(older.related_files(self.facts["raw"], self.facts["modes"].join(visited, "path", "left_semi")))
            self._findings = cut(found.unionByName(rules.notices(self.spark, self.config)))
        return self._findings

    def trace(self, root: str, depth: int = 1, mentions: bool = False) -> dict[str, DataFrame]:
        return review.dossier(self.spark, root, {**self.facts, "findings": self.validate()}, depth, mentions)

    def review(self, specs: list[str]) -> dict[str, DataFrame]:
        return review.review(self.spark, specs, self.facts)

    def impact_parts(self, base: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The changes since a revision, the review queue, its warnings, and what it starts from."""
        changes, hunks = git.changes(self.spark, self.root, base)
        f = self.facts
        start = cut(impact.seeds(changes, hunks, f["occurrences"], f["entities"], f["declarations"], f["annotations"]))
        items = impact.queue(start, f["relations"], f["entities"])
        return changes, items, impact.unchanged_specs(items, changes, start), start

    def impacted(self, base: str) -> tuple[DataFrame, DataFrame]:
        """The review queue and the warnings after the changes since a revision."""
        _, items, warnings, _ = self.impact_parts(base)
        return items.orderBy(impact.kind_rank(F.col("kind")), "id"), warnings

    def slots(self, target: str = ".") -> DataFrame:
        """What the record documents at or below a directory still need: path, line, role, slot, reason."""
        f = self.facts
        looked, missing, _ = slots.targets(f["modes"].select("path", "identity"), target, f["files"].select("path"))
        return slots.inspect(f["lines"], f["records"], looked, missing)

    def status(self) -> DataFrame:
        """Which documents are complete, and what the others lack."""
        gaps = rules.record_fields(self.facts["records"])
        return review.completion(self.facts["records"], gaps, self.facts["paths"])
