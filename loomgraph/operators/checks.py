"""Graph validation: each check gives its offending rows; a summary scores them; repair returns new frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..lineage import cut


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("id")).unionAll(edges.select(F.col("target_id").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    miss = lambda c: edges.join(ids.withColumnRenamed("id", c), c, "left_anti").select("id", "source_id", "target_id")
    return miss("source_id").unionByName(miss("target_id")).distinct()


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source_id = target_id")


def duplicates(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_id", "target_id", "type").agg(F.count("*").alias("n")).where("n > 1")


def missing_properties(nodes: DataFrame, required: list[str] = vocab.REQUIRED_NODE_PROPERTIES) -> DataFrame:
    lost = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    return nodes.select("id", F.array_join(lost, ",").alias("missing")).where("missing <> ''")


def invalid_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = lambda df, kind: df.where("confidence < 0 or confidence > 1").select(F.lit(kind).alias("kind"), "id", "confidence")
    return bad(nodes, "node").unionAll(bad(edges, "edge"))


def wrong_sources(nodes: DataFrame, edges: DataFrame, kind: str = "OBLIGATES", labels: list[str] = vocab.OBLIGATES_SOURCES) -> DataFrame:
    ends = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    return edges.where(F.col("type") == kind).join(ends, "source_id").where(~F.col("source_label").isin(labels)).select("id", "source_id", "source_label")


def trimmed(e: DataFrame) -> DataFrame:
    """The edges (s, t) without those that can't lie on a cycle: nothing is left that a walk leaves for good at once.

    A node whose only way on (or back) leads by single ways to an end goes together with its whole chain: pointers double, so
    a chain costs the logarithm of its length in rounds.
    """
    left = -1
    while True:
        n = e.count()
        if n in (0, left):
            return e
        left = n
        for s, t in (("s", "t"), ("t", "s")):
            single = e.groupBy(s).agg(F.count("*").alias("k"), F.min(t).alias("next")).where("k = 1").select(F.col(s).alias("u"), "next")
            ptr, done = cut(single), -1
            while True:
                on = ptr.select(F.col("u").alias("next"), F.col("next").alias("far"))
                ptr = cut(ptr.join(on, "next", "left").select("u", F.coalesce("far", "next").alias("next"), F.col("far").isNull().alias("out")))
                out = ptr.where("out").count()
                if out == done:
                    break
                done = out
                ptr = ptr.select("u", "next")
            ends = e.select(F.col(t).alias("u")).distinct().join(e.select(F.col(s).alias("u")).distinct(), "u", "left_anti")
            chains = ptr.where("out").join(ends.withColumnRenamed("u", "next"), "next", "left_semi").select("u")
            gone = cut(ends.unionAll(chains))
            e = cut(e.join(gone.withColumnRenamed("u", t), t, "left_anti").join(gone.withColumnRenamed("u", s), s, "left_anti").select("s", "t"))


def cycle_nodes(edges: DataFrame, kind: str = "DEPENDS_ON") -> DataFrame:
    """(node, component): the nodes on cycles of any length, by strongly connected component, which has its smallest node's name.

    After trimming, the largest node that reaches a node is its colour; what reaches its colour's node back inside the colour is a
    component. Components go, and the rest is trimmed again.
    """
    e = trimmed(cut(edges.where(F.col("type") == kind).select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).where("s is not null and t is not null").distinct()))
    found = None
    while not e.isEmpty():
        ids = e.select(F.col("s").alias("v")).union(e.select(F.col("t").alias("v"))).distinct()
        colour, before = cut(ids.withColumn("c", F.col("v"))), None
        while True:
            sums = colour.agg(F.bit_xor(F.xxhash64("v", "c"))).first()[0]
            if sums == before:
                break
            before = sums
            come = e.join(colour.select(F.col("v").alias("s"), "c"), "s").select(F.col("t").alias("v"), "c")
            colour = cut(colour.unionAll(come).groupBy("v").agg(F.max("c").alias("c")))
        of = lambda x: colour.select(F.col("v").alias(x), F.col("c").alias(f"c{x}"))
        inner = cut(e.join(of("s"), "s").join(of("t"), "t").where("cs = ct").select("s", "t", F.col("cs").alias("c")))
        back = front = colour.where("v = c")
        while not front.isEmpty():
            new = inner.join(front.select(F.col("v").alias("t"), "c"), ["t", "c"]).select(F.col("s").alias("v"), "c").distinct()
            front = cut(new.join(back.select("v"), "v", "left_anti").select("v", "c"))
            back = cut(back.unionByName(front))
        part = inner.join(back.select(F.col("v").alias("s")), "s", "left_semi").join(back.select(F.col("v").alias("t")), "t", "left_semi")
        on = cut(back.join(part.select(F.col("s").alias("v")).distinct(), "v", "left_semi"))  # a lone node without a loop is on none
        found = on if found is None else found.unionByName(on)
        gone = back.select("v")
        e = trimmed(cut(e.join(gone.withColumnRenamed("v", "s"), "s", "left_anti").join(gone.withColumnRenamed("v", "t"), "t", "left_anti").select("s", "t")))
    if found is None:
        return edges.select(F.col("source_id").alias("node"), F.col("source_id").alias("component")).limit(0)
    names = found.groupBy("c").agg(F.min("v").alias("component"))
    return found.join(names, "c").select(F.col("v").alias("node"), "component")


def cycles(edges: DataFrame, kind: str = "DEPENDS_ON") -> DataFrame:
    """(start, length) of the cycles of distinct nodes, named by their smallest node; there can be exponentially many."""
    e = trimmed(cut(edges.where(F.col("type") == kind).select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct()))
    trails = e.select(F.col("s").alias("start"), F.col("t").alias("at"), F.array("s", "t").alias("seen"))
    found, length = trails.where("start = at").select("start", F.lit(1).alias("length")), 1
    trails = trails.where("start < at")
    while True:
        length += 1
        step = trails.join(e, trails["at"] == e["s"]).where((F.col("t") == F.col("start")) | ((F.col("t") > F.col("start")) & ~F.array_contains("seen", F.col("t"))))
        step = cut(step.select("start", F.col("t").alias("at"), F.concat("seen", F.array("t")).alias("seen")))
        if step.isEmpty():
            break
        found = found.unionAll(step.where("start = at").select("start", F.lit(length).alias("length")))
        if length % 20 == 0:  # the plan stays short however long the trails
            found = cut(found.coalesce(8))
        trails = step.where("start <> at")
    return found


def wrong_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, side, label): edges whose end has a label that the schema doesn't allow there, for all types: the extended check."""
    rules = [(kind, side, label) for kind, ends in vocab.EDGE_ENDS.items() for side, labels in zip(("source", "target"), ends, strict=True) for label in labels.split()]
    allowed = F.broadcast(edges.sparkSession.createDataFrame(rules, "type string, side string, label string"))
    known = edges.where(F.col("type").isin(*vocab.EDGE_ENDS))
    side = lambda s: known.select("id", "type", F.col(f"{s}_id").alias("node"), F.lit(s).alias("side"))
    ends = side("source").unionAll(side("target")).join(nodes.select(F.col("id").alias("node"), "label"), "node")
    return ends.join(allowed, ["type", "side", "label"], "left_anti").select("id", "side", "label")


SEVERITY = {
    "orphan_nodes": "warning", "dangling_relationships": "error", "self_loops": "error", "duplicate_relationships": "warning",
    "missing_properties": "warning", "invalid_confidence": "error", "circular_dependencies": "warning", "semantic_consistency": "warning",
}


def all_checks(nodes: DataFrame, edges: DataFrame) -> dict[str, tuple[str, DataFrame]]:
    rows = {
        "orphan_nodes": orphans(nodes, edges),
        "dangling_relationships": dangling(nodes, edges),
        "self_loops": self_loops(edges),
        "duplicate_relationships": duplicates(edges),
        "missing_properties": missing_properties(nodes),
        "invalid_confidence": invalid_confidence(nodes, edges),
        "circular_dependencies": cycle_nodes(edges),
        "semantic_consistency": wrong_sources(nodes, edges),
    }
    return {k: (SEVERITY[k], df) for k, df in rows.items()}


def in_document(nodes: DataFrame, edges: DataFrame, document_id: str | None) -> tuple[DataFrame, DataFrame]:
    """The graph, or a document's part of it."""
    return (nodes, edges) if document_id is None else tuple(df.where(F.col("document_id") == document_id) for df in (nodes, edges))


#: Ids that are sent to every task; more are joined.
FEW = 500_000


def few(ids: DataFrame) -> DataFrame:
    """Materialised ids, marked for broadcast if they are few."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def ends_of(edges: DataFrame) -> DataFrame:
    """(id, n, held): how many ends of edges an id is, and of how many it is the source that obligates; materialised."""
    end = lambda c, held: F.struct(F.col(c).alias("id"), held.alias("held"))
    ends = edges.select(F.explode(F.array(end("source_id", F.coalesce(F.col("type") == "OBLIGATES", F.lit(False))), end("target_id", F.lit(False)))).alias("e"))
    return cut(ends.groupBy(F.col("e.id").alias("id")).agg(F.count("*").alias("n"), F.count_if("e.held").alias("held")))


def missing_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(id): what edges name and nodes lack, materialised."""
    return few(ends.where("id is not null").select("id").join(nodes.select("id"), "id", "left_anti"))


def with_lost(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """edges with lost: whether an end is null or missing."""
    gone = lambda side: missing.select(F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}"))
    out = edges.join(gone("source"), "source_id", "left").join(gone("target"), "target_id", "left")
    lost = F.coalesce("_source", F.col("source_id").isNull()) | F.coalesce("_target", F.col("target_id").isNull())
    return out.select(*edges.columns, lost.alias("lost"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, severity, issues, passed): the numbers of rows of all_checks, without making them: nodes are read for all their checks
    together, edges for sums by end, for sums by both ends and type, beside the ends that are missing, and for cycles."""
    beyond = (F.col("confidence") < 0) | (F.col("confidence") > 1)
    lacks = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in vocab.REQUIRED_NODE_PROPERTIES))
    ends = ends_of(edges)
    wrong = F.when(~F.col("label").isin(vocab.OBLIGATES_SOURCES), F.col("held")).otherwise(0)
    of_nodes = nodes.join(ends, "id", "left").agg(F.count_if(F.col("held").isNull()).alias("orphan_nodes"), F.count_if(lacks).alias("missing_properties"), F.count_if(beyond).alias("_nodes"), F.coalesce(F.sum(wrong), F.lit(0)).alias("semantic_consistency"))
    groups = edges.groupBy("source_id", "target_id", "type").agg(F.count("*").alias("n"), F.count_if(beyond).alias("bad"))
    of_edges = groups.agg(F.count_if(F.col("n") > 1).alias("duplicate_relationships"), F.coalesce(F.sum(F.when(F.col("source_id") == F.col("target_id"), F.col("n"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum("bad"), F.lit(0)).alias("_edges"))
    lost = with_lost(edges.select("id", "source_id", "target_id"), missing_ends(nodes, ends)).where("lost").distinct().agg(F.count("*").alias("dangling_relationships"))
    rings = cycle_nodes(edges).agg(F.count("*").alias("circular_dependencies"))
    one = of_nodes.join(of_edges).join(lost).join(rings).withColumn("invalid_confidence", F.col("_nodes") + F.col("_edges"))  # one row each
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), F.col(k).cast("long").alias("issues"), (F.col(k) == 0).alias("passed")) for k, s in SEVERITY.items()))
    return one.select(F.inline(rows))


def quality_score(report: DataFrame) -> DataFrame:
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    t = report.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), failed("error").alias("errors"), failed("warning").alias("warnings"))
    off = F.least(F.lit(0.5), F.col("errors") * F.lit(0.1) + F.col("warnings") * F.lit(0.05))
    return t.select("checks", "passed", "errors", "warnings", F.round(F.greatest(F.lit(0.0), F.col("passed") / F.col("checks") - off), 4).alias("score"))


def keep_best(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the highest confidence, then the smallest id."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("confidence"), "id")
    return df.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def repair(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without dangling edges, self-loops and duplicates, then without orphans."""
    ids = nodes.select("id")
    good = edges.where("source_id <> target_id").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    good = keep_best(good, ["source_id", "target_id", "type"]).select(*edges.columns)
    ends = good.select(F.col("source_id").alias("id")).unionAll(good.select(F.col("target_id").alias("id")))
    return nodes.join(ends, "id", "left_semi"), good


def repair_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: what repair removes, by reason, counted without making the repaired graph: what is lost, loops and groups of more
    than one edge are few beside the edges, and only they are kept, sorted or looked up by id."""
    between = ["source_id", "target_id", "type"]
    e = edges.select("id", *between, "confidence")
    ends = ends_of(e)
    tagged = with_lost(e, missing_ends(nodes, ends))
    odd = cut(tagged.where("lost or source_id = target_id").select("id", "source_id", "target_id", "lost"))
    lost = cut(odd.where("lost").drop("lost").distinct())
    lost_ids = few(lost.select("id").distinct())
    clean = tagged.where("not lost and source_id <> target_id")
    twins = few(clean.groupBy(*between).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"_{c}") for c in between)))
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in between]
    best = Window.partitionBy(*between).orderBy(F.desc_nulls_last("confidence"), "id")
    ranked = clean.join(twins, alike, "left_semi").withColumn("_r", F.row_number().over(best))
    worse = cut(ranked.where("_r > 1").groupBy("id").agg(F.count("*").alias("worse")))
    # an id that another edge keeps isn't removed
    every = clean.join(few(worse.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("every"))
    removed = worse.join(every, "id").where("every = worse").join(lost_ids, "id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    gone = odd.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("gone"))
    ends = ends.join(gone, "id", "left").where("n > coalesce(gone, 0)")  # those of the kept ones: a group keeps one
    parts = [
        one(nodes.join(ends, "id", "left_anti"), "orphan_nodes_removed"),
        one(lost, "dangling_relationships_removed"),
        one(odd.where("not lost").join(lost_ids, "id", "left_anti"), "self_loops_removed"),
        removed.agg(F.coalesce(F.sum("worse"), F.lit(0)).alias("duplicate_relationships_removed")),
    ]
    return reduce(DataFrame.join, parts)
