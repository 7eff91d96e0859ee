"""Graph statistics: counts, degrees, density, coverage, patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basic_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    ratio = lambda x, by: F.when(by > 0, x / by).otherwise(0.0)
    one = n.join(e)  # one row each
    return one.select("nodes", "edges", F.round(ratio(F.col("edges") * 2.0, F.col("nodes")), 2).alias("avg_degree"), F.round(ratio(F.col("edges").cast("double"), F.col("nodes").cast("double") * (F.col("nodes") - 1)), 4).alias("density"))


def by_kind(df: DataFrame, column: str) -> DataFrame:
    c = F.col("confidence")
    return df.groupBy(F.coalesce(column, F.lit("Unknown")).alias(column)).agg(F.count("*").alias("n"), F.round(F.avg(c), 3).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def evidence_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("evidence").isNotNull() & (F.col("evidence") != "")).alias("with_evidence"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text, degree); a self-loop counts once, a node without edges has 0. Edges are read once, and ends are summed before they
    meet nodes."""
    both = F.when(F.col("source_id") != F.col("target_id"), F.array("source_id", "target_id")).otherwise(F.array("source_id"))
    ends = edges.select(F.explode(both).alias("id"))
    return nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", "text", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = F.col("degree")
    return degrees(nodes, edges).agg(F.min(d).alias("min_degree"), F.max(d).alias("max_degree"), F.round(F.avg(d), 4).alias("avg_degree"), F.percentile(d, F.lit(0.5)).alias("median_degree"))


def central(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(k).select("id", F.coalesce(F.substring("text", 1, 50), F.lit("N/A")).alias("text"), "degree")


def coverage(nodes: DataFrame) -> DataFrame:
    """Share of each type, in percent: a small total joins the groups, no window over all rows."""
    groups = nodes.groupBy("type").agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n").alias("total"))
    return groups.join(F.broadcast(total)).select("type", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percentage"))


def patterns(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    side = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("type").alias(f"{s}_type"))
    seen = edges.join(side("source"), "source_id").join(side("target"), "target_id").groupBy("source_type", "type", "target_type").agg(F.count("*").alias("n"))
    return seen.orderBy(F.desc("n"), "source_type", "type", "target_type").limit(k)


def record_statistics(df: DataFrame) -> DataFrame:
    """One row: total, counts by type, and average, least and greatest confidence; zeros if there is none."""
    c = F.col("confidence")
    per = df.groupBy("type").agg(F.count("*").alias("n"))
    kinds = per.agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("k")).select(F.array_join(F.transform("k", lambda x: F.concat_ws("=", x["type"], x["n"].cast("string"))), ",").alias("by_type"))
    three = lambda x, name: F.coalesce(F.round(x, 3), F.lit(0.0)).alias(name)
    has = lambda name: F.count_if(F.coalesce(name, F.lit("")) != "").alias(f"with_{name}")
    more = [has(x) for x in ("evidence", "reasoning") if x in df.columns]
    return df.agg(F.count("*").alias("total"), three(F.avg(c), "avg_confidence"), three(F.min(c), "min_confidence"), three(F.max(c), "max_confidence"), *more).join(kinds)


def label_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label, null ones left out, and relationships by type, the most frequent first."""
    one = lambda df, kind, c: df.where(F.col(c).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one(nodes, "node", "label").unionAll(one(edges, "relationship", "type")).orderBy("kind", F.desc("n"), "name")


def graph_statistics(nodes: DataFrame, edges: DataFrame, with_paths: bool = False) -> dict[str, DataFrame]:
    """All statistics by name; the mean shortest path only on request, as it goes from every node."""
    from .paths import mean_distance

    out = {"basic": basic_counts(nodes, edges), "nodes": by_kind(nodes, "label"), "relationships": by_kind(edges, "type"), "connectivity": degree_summary(nodes, edges), "hub_nodes": central(nodes, edges, 5)}
    return out | ({"paths": mean_distance(edges, nodes)} if with_paths else {})


def document_analysis(nodes: DataFrame, edges: DataFrame, document_id: str, with_paths: bool = False) -> dict[str, DataFrame]:
    """Statistics of a document's part of the graph, with its central entities, coverage and patterns."""
    n, e = nodes.where(F.col("document_id") == document_id), edges.where(F.col("document_id") == document_id)
    return graph_statistics(n, e, with_paths) | {"central": central(n, e, 5), "coverage": coverage(n), "patterns": patterns(n, e)}


def summary_lines(nodes: DataFrame, edges: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(line) of a report of the graph's statistics, and of its checks if their summary is given, in order."""
    s = graph_statistics(nodes, edges)
    blank = lambda part, text: nodes.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("").alias("key"), F.lit(text).alias("line"))

    def told(part: int, df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("at"), F.concat(F.lit(f"  {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias("line")) for k, (label, c) in enumerate(pairs))))
        return df.select(rows.alias("r")).select(F.lit(part).alias("part"), "r.at", F.lit("").alias("key"), "r.line")

    def listed(part: int, df: DataFrame, name: str, what: str) -> DataFrame:
        line = F.concat(F.lit("  "), F.col(name), F.lit(": "), F.col("n").cast("string"), F.lit(f" {what}"), F.coalesce(F.concat(F.lit(", average confidence "), F.col("avg_confidence").cast("string")), F.lit("")))
        return df.select(F.lit(part).alias("part"), F.lit(1).cast("long").alias("at"), F.col(name).alias("key"), line.alias("line"))

    hubs = s["hub_nodes"].select(F.lit(7).alias("part"), (-F.col("degree")).alias("at"), F.col("id").alias("key"), F.concat(F.lit("  "), "text", F.lit(" (degree "), F.col("degree").cast("string"), F.lit(")")).alias("line"))
    parts = [
        blank(0, "GRAPH SUMMARY"),
        told(1, s["basic"], [("Nodes", "nodes"), ("Relationships", "edges"), ("Average degree", "avg_degree"), ("Density", "density")]),
        blank(2, "Node labels"),
        listed(3, s["nodes"], "label", "nodes"),
        blank(4, "Relationship types"),
        listed(5, s["relationships"], "type", "relationships"),
        blank(6, "Connectivity").unionAll(told(6, s["connectivity"], [("Least degree", "min_degree"), ("Greatest degree", "max_degree"), ("Average degree", "avg_degree"), ("Median degree", "median_degree")]).withColumn("at", F.col("at") + 1)),
        hubs,
    ]
    if checks is not None:
        total = checks.agg(F.sum("issues").alias("total"))
        parts.append(told(8, total, [("Issues found by the checks", "total")]))
        parts.append(checks.select(F.lit(9).alias("part"), F.lit(0).cast("long").alias("at"), F.col("check").alias("key"), F.concat(F.lit("  "), "check", F.lit(": "), F.col("issues").cast("string")).alias("line")))
    return reduce(DataFrame.unionByName, parts).orderBy("part", "at", "key").select("line")


def write_summary(nodes: DataFrame, edges: DataFrame, path: str, checks: DataFrame | None = None) -> None:
    """The report as one text file: it is short whatever the graph's size."""
    summary_lines(nodes, edges, checks).coalesce(1).write.mode("overwrite").text(path)
