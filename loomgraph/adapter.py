"""A property graph over the star schema: nodes and edges as DataFrames, and the same views as DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, by: str) -> DataFrame:
    """The rows of a table by a key, over so many tasks that none gets more of it the larger it is; few for a small one. What goes on
    by this key needs no other exchange."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(-(-size // TASK_BYTES), min(usual, -(-size // LEAST_BYTES)), 1), by)


def graded(key, base: float, steps: int):
    return F.lit(base) + (key % steps) / F.lit(100.0)


#: Bytes of a table's files for a task, at most, and at least where there are tasks to spare.
TASK_BYTES, LEAST_BYTES = 4_000_000, 500_000
#: One defect of each kind, for the checks.
BAD_NODES = [
    ("orphan_1", "Lonely", "Legal_Concept", "LegalConcept", 0.6, "doc_x"),
    ("null_1", None, "Legal_Concept", "LegalConcept", 0.6, "doc_x"),
    ("low_1", "Low", "Legal_Concept", "LegalConcept", -0.1, "doc_x"),
    ("high_1", "High", "Legal_Concept", "LegalConcept", 1.2, "doc_x"),
    ("ring_a", "A", "Obligation", "Obligation", 0.9, "doc_x"),
    ("ring_b", "B", "Obligation", "Obligation", 0.9, "doc_x"),
    ("ring_c", "C", "Obligation", "Obligation", 0.9, "doc_x"),
    ("court_1", "Court", "Jurisdiction", "Jurisdiction", 0.9, "doc_x"),
]
BAD_EDGES = [
    ("bad_dangling", "ring_a", "missing_1", "REFERENCES", 0.8, None, "doc_x"),
    ("bad_loop", "ring_a", "ring_a", "REFERENCES", 0.8, None, "doc_x"),
    ("bad_twin_1", "low_1", "high_1", "REFERENCES", 0.7, None, "doc_x"),
    ("bad_twin_2", "low_1", "high_1", "REFERENCES", 0.9, None, "doc_x"),
    ("bad_high", "null_1", "high_1", "MODIFIES", 1.2, None, "doc_x"),
    ("ring_1", "ring_a", "ring_b", "DEPENDS_ON", 0.8, None, "doc_x"),
    ("ring_2", "ring_b", "ring_c", "DEPENDS_ON", 0.8, None, "doc_x"),
    ("ring_3", "ring_c", "ring_a", "DEPENDS_ON", 0.8, None, "doc_x"),
    ("bad_court", "court_1", "ring_a", "OBLIGATES", 0.8, "the court shall", "doc_x"),
    ("contra_1", "ring_a", "ring_c", "CONTRADICTS", 0.75, None, "doc_x"),
]


def graph(spark: SparkSession, sf_dir: str, defects: bool = False) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    doc = lambda c: F.concat(F.lit("doc_"), c.cast("string")).alias("document_id")
    key = lambda prefix, c: F.concat(F.lit(prefix + "_"), c.cast("string"))
    c, o, p, n = t("customer"), t("orders"), t("part"), t("nation")
    node = lambda df, i, text, kind, conf, d: df.select(i.alias("id"), text.alias("text"), F.lit(kind).alias("type"), F.lit(vocab.label_of(kind)).alias("label"), conf.alias("confidence"), d)
    placed = dealt(o, "o_custkey").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    nodes = (
        node(c, key("cust", F.col("c_custkey")), F.col("c_name"), "Legal_Party", graded(F.col("c_custkey"), 0.5, 50), doc(F.col("c_nationkey")))
        .unionAll(node(n, key("nat", F.col("n_nationkey")), F.col("n_name"), "Jurisdiction", F.lit(0.9), doc(F.col("n_nationkey"))))
        .unionAll(node(placed, key("ord", F.col("o_orderkey")), F.col("o_orderpriority"), "Obligation", graded(F.col("o_orderkey"), 0.5, 50), doc(F.col("c_nationkey"))))
        .unionAll(node(p, key("part", F.col("p_partkey")), F.col("p_name"), "Legal_Concept", graded(F.col("p_partkey"), 0.5, 50), F.lit("doc_catalog").alias("document_id")))
    )
    edge = lambda df, i, s, g, kind, conf, d, ev=None: df.select(i.alias("id"), s.alias("source_id"), g.alias("target_id"), F.lit(kind).alias("type"), conf.alias("confidence"), (F.lit(None).cast("string") if ev is None else ev).alias("evidence"), d)
    items = dealt(t("lineitem"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("discount"))
    told = items.join(placed.select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey"), "l_orderkey")
    after = placed.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("next is not null")
    edges = (
        edge(c, key("gov", F.col("c_custkey")), key("nat", F.col("c_nationkey")), key("cust", F.col("c_custkey")), "GOVERNS", F.lit(0.8), doc(F.col("c_nationkey")))
        .unionAll(edge(placed, key("obl", F.col("o_orderkey")), key("cust", F.col("o_custkey")), key("ord", F.col("o_orderkey")), "OBLIGATES", graded(F.col("o_orderkey"), 0.6, 40), doc(F.col("c_nationkey")), F.concat(F.lit("shall deliver "), F.col("o_orderpriority"))))
        .unionAll(edge(told, F.concat(key("ref", F.col("l_orderkey")), F.lit("_"), F.col("l_partkey").cast("string")), key("ord", F.col("l_orderkey")), key("part", F.col("l_partkey")), "REFERENCES", 1 - F.col("discount"), doc(F.col("c_nationkey"))))
        .unionAll(edge(after, key("dep", F.col("o_orderkey")), key("ord", F.col("o_orderkey")), key("ord", F.col("next")), "DEPENDS_ON", F.lit(0.7), doc(F.col("c_nationkey"))))
    )
    if defects:
        nodes = nodes.unionAll(spark.createDataFrame(BAD_NODES, vocab.NODES))
        edges = edges.unionAll(spark.createDataFrame(BAD_EDGES, vocab.EDGES))
    return Graph(nodes, edges)


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


def graph_sql(defects: bool = False) -> str:
    """``nodes`` and ``edges`` as common table expressions, to go after WITH."""
    half, six = "CAST(0.5 AS DOUBLE) + ({} % 50) / CAST(100 AS DOUBLE)", "CAST(0.6 AS DOUBLE) + ({} % 40) / CAST(100 AS DOUBLE)"
    return f"""placed AS (SELECT o.*, c_nationkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders o JOIN customer ON o_custkey = c_custkey),
nodes AS (SELECT 'cust_' || c_custkey AS id, c_name AS text, 'Legal_Party' AS type, 'LegalParty' AS label, {half.format("c_custkey")} AS confidence, 'doc_' || c_nationkey AS document_id FROM customer
  UNION ALL SELECT 'nat_' || n_nationkey, n_name, 'Jurisdiction', 'Jurisdiction', CAST(0.9 AS DOUBLE), 'doc_' || n_nationkey FROM nation
  UNION ALL SELECT 'ord_' || o_orderkey, o_orderpriority, 'Obligation', 'Obligation', {half.format("o_orderkey")}, 'doc_' || c_nationkey FROM placed
  UNION ALL SELECT 'part_' || p_partkey, p_name, 'Legal_Concept', 'LegalConcept', {half.format("p_partkey")}, 'doc_catalog' FROM part
  {"UNION ALL " + _values(BAD_NODES, "id, text, type, label, confidence, document_id") if defects else ""}),
items AS (SELECT l_orderkey, l_partkey, max(l_discount) AS discount FROM lineitem GROUP BY ALL),
edges AS (SELECT 'gov_' || c_custkey AS id, 'nat_' || c_nationkey AS source_id, 'cust_' || c_custkey AS target_id, 'GOVERNS' AS type, CAST(0.8 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS evidence, 'doc_' || c_nationkey AS document_id FROM customer
  UNION ALL SELECT 'obl_' || o_orderkey, 'cust_' || o_custkey, 'ord_' || o_orderkey, 'OBLIGATES', {six.format("o_orderkey")}, 'shall deliver ' || o_orderpriority, 'doc_' || c_nationkey FROM placed
  UNION ALL SELECT 'ref_' || l_orderkey || '_' || l_partkey, 'ord_' || l_orderkey, 'part_' || l_partkey, 'REFERENCES', 1 - discount, NULL, 'doc_' || c_nationkey FROM items JOIN placed ON l_orderkey = o_orderkey
  UNION ALL SELECT 'dep_' || o_orderkey, 'ord_' || o_orderkey, 'ord_' || next, 'DEPENDS_ON', CAST(0.7 AS DOUBLE), NULL, 'doc_' || c_nationkey FROM placed WHERE next IS NOT NULL
  {"UNION ALL " + _values(BAD_EDGES, "id, source_id, target_id, type, confidence, evidence, document_id") if defects else ""})"""
