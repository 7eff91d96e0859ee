"""The requests that a user of the graph makes, as methods: bounds are checked, results are DataFrames or small records."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import paths, retrieve, search, stats


def bounded(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


@dataclass
class GraphService:
    """A graph and, if there are any, live models: one for queries (prompt to reply), one for answers (question, context to reply)."""

    nodes: DataFrame
    edges: DataFrame
    translator: Callable[[str], str] | None = None
    generator: retrieve.Generator = retrieve.extractive

    def health(self) -> dict:
        """healthy if the graph can be read, else degraded."""
        try:
            self.nodes.limit(1).count()
            self.edges.limit(1).count()
            return {"status": "healthy", "graph": True, "models": self.translator is not None}
        except Exception as e:
            return {"status": "degraded", "graph": False, "error": str(e).splitlines()[0]}

    def statistics(self, document_id: str | None = None) -> dict:
        """Counts, histograms and density of the graph or of a document's part."""
        n, e = (df if document_id is None else df.where(F.col("document_id") == document_id) for df in (self.nodes, self.edges))
        basic = stats.basic_counts(n, e).first().asDict()
        by = lambda df, c: {r[c]: r["n"] for r in stats.by_kind(df, c).collect()}
        return basic | {"node_types": by(n, "label"), "relationship_types": by(e, "type")}

    def entities(self, text: str | None = None, kind: str | None = None, document_id: str | None = None, least: float = 0.0, limit: int = 10) -> DataFrame:
        bounded("min_confidence", least, 0, 1)
        bounded("limit", limit, 1, 100)
        return search.search_nodes(self.nodes, text, kind, document_id, least, limit)

    def relationships(self, source: str | None = None, target: str | None = None, kind: str | None = None, document_id: str | None = None, least: float = 0.0, limit: int = 10) -> DataFrame:
        bounded("min_confidence", least, 0, 1)
        bounded("limit", limit, 1, 100)
        return search.search_edges(self.nodes, self.edges, source, target, kind, document_id, least, limit)

    def path(self, source: str, target: str, depth: int = 3, kinds: list[str] | None = None) -> DataFrame:
        """Trails between two nodes, the shortest first; an end that isn't there is an error."""
        bounded("max_depth", depth, 1, 5)
        for end in (source, target):
            if self.nodes.where(F.col("id") == end).isEmpty():
                raise LookupError(end)
        return paths.trails(self.edges, source, target, depth, kinds)

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """A reading query over nodes and edges with named parameters; anything else, or one that can't be analysed, is refused."""
        ok, why = retrieve.valid(self.nodes, self.edges, sql, args)
        if not ok:
            raise ValueError(why)
        return retrieve.query(self.nodes, self.edges, sql, args)

    def question(self, text: str, document_id: str | None = None, limit: int = 20) -> dict:
        """The query that a question became, and its rows."""
        began = time.time()
        sql, why = retrieve.translate(text, document_id, self.translator)
        rows = [r.asDict() for r in self.query(sql).limit(limit).collect()]
        return {"question": text, "query": sql, "reasoning": why, "results": rows, "count": len(rows), "seconds": time.time() - began}

    def answer(self, text: str, document_id: str | None = None, entities: int = 10, relationships: int = 10, sources: bool = True) -> dict:
        bounded("max_context_entities", entities, 1, 50)
        bounded("max_context_relationships", relationships, 1, 50)
        return retrieve.answer(self.nodes, self.edges, text, document_id, entities, relationships, sources, self.generator)

    def questions(self) -> list[str]:
        return list(retrieve.COMPETENCY_QUESTIONS)
