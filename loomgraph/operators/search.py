"""Scans, searches and adjacency over nodes and edges. Every limit has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_nodes(nodes: DataFrame, limit: int | None = 100, **equal) -> DataFrame:
    """Nodes whose columns equal the given values; a null never equals."""
    for k, v in equal.items():
        nodes = nodes.where(F.col(k) == v)
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def search_nodes(nodes: DataFrame, text: str | None = None, kind: str | None = None, document_id: str | None = None, least: float = 0.0, limit: int = 10, ignore_case: bool = True) -> DataFrame:
    if text is not None:
        nodes = nodes.where(F.contains(F.lower("text"), F.lit(text.lower())) if ignore_case else F.col("text").contains(text))
    if kind is not None:
        nodes = nodes.where(F.col("type") == kind)
    if document_id is not None:
        nodes = nodes.where(F.col("document_id") == document_id)
    return nodes.where(F.col("confidence") >= least).orderBy(F.desc_nulls_first("confidence"), "id").limit(limit)


def search_edges(nodes: DataFrame, edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None, document_id: str | None = None, least: float = 0.0, limit: int | None = 10) -> DataFrame:
    """Edges with both ends' texts, best first. The top is chosen before the ends are joined where every edge has ends."""
    for c, v in (("source_id", source), ("target_id", target), ("type", kind), ("document_id", document_id)):
        if v is not None:
            edges = edges.where(F.col(c) == v)
    edges = edges.where(F.col("confidence") >= least)
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"), F.col("type").alias(f"{side}_type"))
    found = edges.join(end("source"), "source_id").join(end("target"), "target_id")
    found = found.select("id", "type", "confidence", "source_id", "source_text", "source_type", "target_id", "target_text", "target_type")
    return found if limit is None else found.orderBy(F.desc_nulls_first("confidence"), "id").limit(limit)


def oriented(edges: DataFrame) -> DataFrame:
    """(node, other, edge columns) both ways round; a self-loop once."""
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), F.col("id").alias("edge_id"), "type")
    back = edges.where("source_id <> target_id").select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), F.col("id").alias("edge_id"), "type")
    return out.unionAll(back)


def neighbours(edges: DataFrame, node: str, direction: str = "both", limit: int | None = None) -> DataFrame:
    s, t = F.col("source_id") == node, F.col("target_id") == node
    found = edges.where({"outgoing": s, "incoming": t, "both": s | t}[direction])
    return found if limit is None else found.orderBy("id").limit(limit)


def edges_of(edges: DataFrame, ids: DataFrame, limit: int = 10) -> DataFrame:
    """The best edges that touch any of ids (column id)."""
    ids = ids.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return out.unionByName(into).dropDuplicates(["id"]).orderBy(F.desc_nulls_first("confidence"), "id").limit(limit)


def prepared(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The prepared queries by name."""
    return {
        "parties": nodes.where("type = 'Legal_Party'").select("id", "text", "confidence"),
        "obligations": search_edges(nodes, edges, kind="OBLIGATES", limit=None),
        "high_confidence": nodes.where("confidence > 0.9D").select("id", "text", "type", "confidence"),
        "distribution": edges.groupBy("type").agg(F.count("*").alias("n")),
        "contradictions": search_edges(nodes, edges, kind="CONTRADICTS", limit=None),
    }
