"""Paths: bounded trails, shortest distances, PageRank. Frontiers are joined step by step and cut at each."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..lineage import cut as checkpointed
from .search import oriented


def trails(edges: DataFrame, start: str, end: str, depth: int = 3, kinds: list[str] | None = None, limit: int | None = 10) -> DataFrame:
    """(edge_ids, length) of undirected trails between two nodes: an edge at most once, nodes may repeat."""
    if kinds:
        edges = edges.where(F.col("type").isin(kinds))
    both = oriented(edges).select("node", "other", "edge_id")
    now = both.where(F.col("node") == start).select(F.col("other").alias("at"), F.array("edge_id").alias("path"))
    found = now.where(F.col("at") == end)
    for _ in range(depth - 1):
        now = now.join(both, now["at"] == both["node"]).where(~F.array_contains("path", F.col("edge_id"))).select(F.col("other").alias("at"), F.concat("path", F.array("edge_id")).alias("path"))
        found = found.unionAll(now.where(F.col("at") == end))
    found = found.select(F.array_join("path", ">").alias("edge_ids"), F.size("path").cast("long").alias("length"))
    return found if limit is None else found.orderBy("length", "edge_ids").limit(limit)


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, distance) by breadth-first search from each id of sources, undirected, until no node is new."""
    step = checkpointed(oriented(edges).select("node", "other").distinct())
    seen = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for d in count(1) if most is None else range(1, most + 1):
        new = front.join(step, "node").select("source", F.col("other").alias("node")).distinct().join(seen, ["source", "node"], "left_anti")
        front = checkpointed(new.withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


#: Words of 64 sources that a task follows together, and entries (links or nodes times words) that it has at hand for that.
WORDS, ENTRIES = 8, 8_000_000


def numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """(names with n: 0, 1, ..., their number), numbered where they lie."""
    placed = cut(names.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    first, total = [], 0
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("k")).orderBy("p").collect():  # a row for each partition
        first.append((r["p"], total))
        total += r["k"]
    starts = F.broadcast(names.sparkSession.createDataFrame(first, "_p long, _first long"))
    row = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, part == F.col("_p")).select(*names.columns, (F.col("_first") + row).cast("int").alias("n")), total


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all the spans, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def met(at: np.ndarray, of: np.ndarray, own: np.ndarray, sources: np.ndarray, words: int, most: int | None) -> Iterator[tuple[int, int]]:
    """(distance, pairs) from sources to own nodes by breadth-first search from all sources at once: a node has a bit for each.

    of[at[v] : at[v + 1]] are v's neighbours. Only nodes next to the front are looked at, in parts of a bounded size.
    """
    degree = np.diff(at)
    front = np.zeros((len(degree), words), np.uint64)
    k = np.arange(len(sources))
    front[sources, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    seen, everyone = front.copy(), np.flatnonzero(degree)
    for d in count(1) if most is None else range(1, most + 1):
        now = np.flatnonzero(front.any(axis=1))
        if degree[now].sum() * 4 < len(of):
            next_to = np.zeros(len(degree), bool)
            next_to[of[spans(at[now], degree[now])]] = True
            near = np.flatnonzero(next_to)
        else:
            near = everyone
        new = np.zeros_like(front)
        runs = np.cumsum(degree[near]) // max(1, ENTRIES // words)
        for part in np.split(near, np.flatnonzero(np.diff(runs)) + 1) if len(near) else []:
            links = degree[part]
            new[part] = np.bitwise_or.reduceat(front[of[spans(at[part], links)]], np.cumsum(links) - links, axis=0)
        new &= ~seen
        if not new.any():
            return
        seen |= new
        front = new
        if n := int(np.bitwise_count(new[own]).sum()):
            yield d, n


def mean_distance(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Mean shortest path over connected unordered pairs of nodes; a path may lead over any edges and other nodes.

    The graph's links go to every worker as numbers; each task follows some sources through all of it, 64 in a word. So a task's
    memory grows with the graph, not with the pairs, and no pair leaves Python; the work is that of all pairs.
    """
    spark = edges.sparkSession
    ids = nodes.select("id").where("id is not null").distinct()
    both = oriented(edges).where("node is not null and other is not null").select("node", "other")
    names, total = numbered(ids.withColumn("own", F.lit(1)).unionByName(both.select(F.col("node").alias("id"), F.lit(0).alias("own"))).groupBy("id").agg(F.max("own").alias("own")))
    number = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    links = both.distinct().join(number("node"), "node").join(number("other"), "other").select("node_n", "other_n").toArrow()
    to, of = (links.column(c).to_numpy() for c in ("node_n", "other_n"))
    own = np.sort(names.where("own = 1").select("n").toArrow().column("n").to_numpy())
    at = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=total))]).astype(np.int64)
    told = spark.sparkContext.broadcast((at, of[np.argsort(to, kind="stable")], own))
    words = max(1, min(WORDS, ENTRIES // max(1, len(of), total), -(-len(own) // 64)))
    blocks = -(-len(own) // (64 * words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, of, own = told.value
        for b in batches:
            for k in b["id"]:
                yield pd.DataFrame(met(at, of, own, own[k * 64 * words : (k + 1) * 64 * words], words, most), columns=["distance", "n"])

    found = spark.range(0, blocks, 1, max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "distance long, n long")
    every = F.sum("n")  # each pair from both its ends
    return found.agg((F.coalesce(every, F.lit(0)) / 2).cast("long").alias("pairs"), F.round(F.sum(F.col("distance") * F.col("n")) / every, 4).alias("avg_distance"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank); ranks sum to the number of nodes. Contributions are pre-aggregated sums; each third round is cut."""
    out = edges.groupBy("source_id").agg(F.count("*").alias("out"))
    links = checkpointed(edges.select("source_id", "target_id").join(out, "source_id"))
    ids = cut(nodes.select("id").distinct())  # read in each round
    rank = ids.withColumn("rank", F.lit(1.0))
    for k in range(rounds):
        given = links.join(rank, links["source_id"] == rank["id"]).groupBy("target_id").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = ids.join(given, ids["id"] == given["target_id"], "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 3 == 2:
            rank = checkpointed(rank)
    return rank
