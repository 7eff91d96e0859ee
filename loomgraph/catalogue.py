"""All registered queries of the graph operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .adapter import Graph, graded, graph, graph_sql, table
from .functions import chunk
from .functions import text as T
from .lineage import spread
from .operators import checks, evaluate, export, extract, mutate, paths, resolve, retrieve, rules, search, stats
from .plans import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
G, GD = graph_sql(), graph_sql(True)


def of_graph(name: str, sql: str | None, defects: bool = False):
    """Registers a query over the adapter's graph; sql follows the views' definitions."""

    def take(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, d: f(graph(spark, d, defects))
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {GD if defects else G}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return take


def of_table(name: str, tables: str, sql: str | None):
    def take(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, d: f(*(table(spark, d, t) for t in tables.split()))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return take


EDGE_COLUMNS = "e.id, e.type, e.confidence, source_id, s.text AS source_text, s.type AS source_type, target_id, t.text AS target_text, t.type AS target_type"
JOINED = f"SELECT {EDGE_COLUMNS} FROM edges e JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id"

of_graph("rel_search", f"{JOINED} WHERE e.type = 'OBLIGATES' AND e.document_id = 'doc_3' AND e.confidence >= 0.8 ORDER BY e.confidence DESC, e.id LIMIT 10")(lambda g: search.search_edges(g.nodes, g.edges, kind="OBLIGATES", document_id="doc_3", least=0.8))
of_graph("rel_search_all", f"{JOINED} WHERE e.type = 'OBLIGATES' AND e.confidence >= 0.8 ORDER BY e.confidence DESC, e.id LIMIT 100")(lambda g: search.search_edges(g.nodes, g.edges, kind="OBLIGATES", least=0.8, limit=100))
NODE = "id, text, type, label, confidence, document_id"
of_graph("entity_search", f"SELECT {NODE} FROM nodes WHERE contains(lower(text), 'customer') AND type = 'Legal_Party' AND confidence >= 0.7 ORDER BY confidence DESC, id LIMIT 10")(lambda g: search.search_nodes(g.nodes, "Customer", "Legal_Party", least=0.7))
of_graph("text_search", f"SELECT {NODE} FROM nodes WHERE contains(text, 'URGENT') AND confidence >= 0 ORDER BY confidence DESC, id LIMIT 20")(lambda g: search.search_nodes(g.nodes, "URGENT", limit=20, ignore_case=False))
of_graph("nodes_by_document", f"SELECT {NODE} FROM nodes WHERE document_id = 'doc_3'")(lambda g: search.find_nodes(g.nodes, None, document_id="doc_3"))
of_graph("nodes_by_type", f"SELECT {NODE} FROM nodes WHERE type = 'Jurisdiction' ORDER BY id LIMIT 100")(lambda g: search.find_nodes(g.nodes, 100, type="Jurisdiction"))
of_graph("node_by_id", f"SELECT {NODE} FROM nodes WHERE id = 'cust_7'")(lambda g: search.find_nodes(g.nodes, 1, id="cust_7"))
EDGE = "id, source_id, target_id, type, confidence, evidence, document_id"
for _d, _w in (("outgoing", "source_id = 'cust_7'"), ("incoming", "target_id = 'cust_7'"), ("both", "source_id = 'cust_7' OR target_id = 'cust_7'")):
    of_graph(f"neighbours_{_d}", f"SELECT {EDGE} FROM edges WHERE {_w}")(lambda g, d=_d: search.neighbours(g.edges, "cust_7", d))
of_graph("rels_by_document", f"SELECT {EDGE} FROM edges WHERE document_id = 'doc_3'")(lambda g: g.edges.where("document_id = 'doc_3'"))
of_graph("rels_by_type", f"SELECT {EDGE} FROM edges WHERE type = 'GOVERNS' ORDER BY id LIMIT 100")(lambda g: search.find_nodes(g.edges, 100, type="GOVERNS"))
of_graph("edges_of_set", f"SELECT {EDGE} FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE type = 'Jurisdiction') OR target_id IN (SELECT id FROM nodes WHERE type = 'Jurisdiction') ORDER BY confidence DESC, id LIMIT 10")(lambda g: search.edges_of(g.edges, g.nodes.where("type = 'Jurisdiction'")))
PREPARED = {"parties": "SELECT id, text, confidence FROM nodes WHERE type = 'Legal_Party'", "obligations": f"{JOINED} WHERE e.type = 'OBLIGATES' AND e.confidence >= 0", "high_confidence": "SELECT id, text, type, confidence FROM nodes WHERE confidence > CAST(0.9 AS DOUBLE)", "distribution": "SELECT type, count(*) AS n FROM edges GROUP BY type", "contradictions": f"{JOINED} WHERE e.type = 'CONTRADICTS' AND e.confidence >= 0"}
for _k, _sql in PREPARED.items():
    of_graph(f"prepared_{_k}", _sql, True)(lambda g, k=_k: search.prepared(g.nodes, g.edges)[k])

of_graph("graph_counts", "SELECT n AS nodes, e AS edges, round(e * 2.0 / n, 2) AS avg_degree, round(CAST(e AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1)), 4) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges)")(lambda g: stats.basic_counts(g.nodes, g.edges))
KIND = "count(*) AS n, round(avg(confidence), 3) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence"
of_graph("node_stats", f"SELECT coalesce(label, 'Unknown') AS label, {KIND} FROM nodes GROUP BY 1")(lambda g: stats.by_kind(g.nodes, "label"))
of_graph("rel_stats", f"SELECT coalesce(type, 'Unknown') AS type, {KIND} FROM edges GROUP BY 1")(lambda g: stats.by_kind(g.edges, "type"))
of_graph("rel_evidence_stats", "SELECT type, count(*) AS n, count(*) FILTER (evidence <> '') AS with_evidence FROM edges GROUP BY type")(lambda g: stats.evidence_counts(g.edges))
DEG = ", ends AS (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges WHERE source_id <> target_id), deg AS (SELECT n.id, text, coalesce(d, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS d FROM ends GROUP BY id) e ON n.id = e.id)"
of_graph("degree_distribution", f"{DEG} SELECT min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 4) AS avg_degree, quantile_cont(degree, 0.5) AS median_degree FROM deg", True)(lambda g: stats.degree_summary(g.nodes, g.edges))
of_graph("degree_centrality", f"{DEG} SELECT id, coalesce(substring(text, 1, 50), 'N/A') AS text, degree FROM deg ORDER BY degree DESC, id LIMIT 10")(lambda g: stats.central(g.nodes, g.edges))
of_graph("entity_coverage", "SELECT type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM nodes WHERE document_id = 'doc_3'), 1) AS percentage FROM nodes WHERE document_id = 'doc_3' GROUP BY type")(lambda g: stats.coverage(g.nodes.where("document_id = 'doc_3'")))
of_graph("rel_patterns", "SELECT s.type AS source_type, e.type AS type, t.type AS target_type, count(*) AS n FROM edges e JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 20")(lambda g: stats.patterns(g.nodes, g.edges))

ORPHAN = "SELECT * FROM nodes WHERE id NOT IN (SELECT source_id FROM edges UNION ALL SELECT target_id FROM edges)"
DANGLING = "SELECT id, source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)"
TWINS = "SELECT source_id, target_id, type, count(*) AS n FROM edges GROUP BY 1, 2, 3 HAVING count(*) > 1"
MISSING = "SELECT id, array_to_string(list_filter([CASE WHEN text IS NULL THEN 'text' END, CASE WHEN type IS NULL THEN 'type' END, CASE WHEN confidence IS NULL THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS missing FROM nodes WHERE text IS NULL OR type IS NULL OR confidence IS NULL"
RANGE = "SELECT 'node' AS kind, id, confidence FROM nodes WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT 'edge', id, confidence FROM edges WHERE confidence < 0 OR confidence > 1"
WRONG = "SELECT e.id, source_id, label AS source_label FROM edges e JOIN nodes s ON source_id = s.id WHERE e.type = 'OBLIGATES' AND label NOT IN ('LegalParty', 'Clause')"
ENDS = " UNION ALL ".join(f"SELECT '{kind}' AS type, '{side}' AS side, '{label}' AS label" for kind, ends in vocab.EDGE_ENDS.items() for side, labels in zip(("source", "target"), ends, strict=True) for label in labels.split())
RINGS = ", deps AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE type = 'DEPENDS_ON'), reach AS (SELECT s, t FROM deps UNION SELECT r.s, d.t FROM reach r JOIN deps d ON r.t = d.s), cyclic AS (SELECT a.s AS node, min(b.s) AS component FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s GROUP BY a.s)"
of_graph("chk_orphans", f"SELECT {NODE} FROM ({ORPHAN})", True)(lambda g: checks.orphans(g.nodes, g.edges))
of_graph("chk_dangling", DANGLING, True)(lambda g: checks.dangling(g.nodes, g.edges))
of_graph("chk_self_loops", f"SELECT {EDGE} FROM edges WHERE source_id = target_id", True)(lambda g: checks.self_loops(g.edges))
of_graph("chk_duplicates", TWINS, True)(lambda g: checks.duplicates(g.edges))
of_graph("chk_missing", MISSING, True)(lambda g: checks.missing_properties(g.nodes))
of_graph("chk_confidence", RANGE, True)(lambda g: checks.invalid_confidence(g.nodes, g.edges))
of_graph("chk_semantic", WRONG, True)(lambda g: checks.wrong_sources(g.nodes, g.edges))
of_graph("chk_cycles", f"{RINGS} SELECT node, component FROM cyclic", True)(lambda g: checks.cycle_nodes(g.edges))
of_graph("chk_ends", f", rules AS ({ENDS}) SELECT id, side, label FROM (SELECT e.id, e.type, 'source' AS side, label FROM edges e JOIN nodes n ON source_id = n.id UNION ALL SELECT e.id, e.type, 'target', label FROM edges e JOIN nodes n ON target_id = n.id) x WHERE type IN (SELECT type FROM rules) AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.type = x.type AND r.side = x.side AND r.label = x.label)", True)(lambda g: checks.wrong_ends(g.nodes, g.edges))
_bad = ", ".join(f"('{k}', '{s}', (SELECT count(*) FROM ({q})))" for k, s, q in (("orphan_nodes", "warning", ORPHAN), ("dangling_relationships", "error", DANGLING), ("self_loops", "error", "SELECT id FROM edges WHERE source_id = target_id"), ("duplicate_relationships", "warning", TWINS), ("missing_properties", "warning", MISSING), ("invalid_confidence", "error", RANGE), ("circular_dependencies", "warning", "SELECT node FROM cyclic"), ("semantic_consistency", "warning", WRONG)))
REPORT = f"{RINGS}, r AS (SELECT *, issues = 0 AS passed FROM (VALUES {_bad}) AS v(check_, severity, issues))"
of_graph("graph_validation", f"{REPORT} SELECT check_ AS \"check\", severity, issues, passed FROM r", True)(lambda g: checks.summary(g.nodes, g.edges))
of_graph("quality_score", f"{REPORT}, q AS (SELECT count(*) AS checks, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity = 'warning') AS warnings FROM r) SELECT *, round(greatest(CAST(0 AS DOUBLE), passed / checks - least(CAST(0.5 AS DOUBLE), errors * CAST(0.1 AS DOUBLE) + warnings * CAST(0.05 AS DOUBLE))), 4) AS score FROM q", True)(lambda g: checks.quality_score(checks.summary(g.nodes, g.edges)))
REPAIRED = f", good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY confidence DESC, id) AS r FROM edges WHERE source_id <> target_id AND source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)) WHERE r = 1) SELECT {EDGE} FROM good"
of_graph("repaired_edges", REPAIRED, True)(lambda g: checks.repair(g.nodes, g.edges)[1])
of_graph("edge_dedupe", f"SELECT {EDGE} FROM (SELECT *, row_number() OVER (PARTITION BY source_id, type ORDER BY confidence DESC, id) AS r FROM edges) WHERE r = 1")(lambda g: checks.keep_best(g.edges, ["source_id", "type"]))

WALK = """, sub AS (SELECT * FROM edges WHERE type IN ('GOVERNS', 'OBLIGATES')),
both_ways AS (SELECT source_id AS node, target_id AS other, id FROM sub UNION ALL SELECT target_id, source_id, id FROM sub WHERE source_id <> target_id),
walk AS (SELECT other AS place, id AS edge_ids, [id] AS seen, 1 AS length FROM both_ways WHERE node = 'nat_3' UNION ALL SELECT other, edge_ids || '>' || id, list_append(seen, id), length + 1 FROM walk JOIN both_ways ON place = node WHERE length < 3 AND NOT list_contains(seen, id))"""
of_graph("paths_bounded", f"{WALK} SELECT edge_ids, CAST(length AS BIGINT) AS length FROM walk WHERE place = (SELECT min(target_id) FROM sub WHERE type = 'OBLIGATES' AND document_id = 'doc_3') ORDER BY length, edge_ids LIMIT 10")(
    lambda g: paths.trails(g.edges, "nat_3", g.edges.where("document_id = 'doc_3' and type = 'OBLIGATES'").agg(F.min("target_id")).first()[0] or "", kinds=["GOVERNS", "OBLIGATES"])
)
BFS = """, sub AS (SELECT source_id AS a, target_id AS b FROM edges WHERE document_id = 'doc_3' UNION SELECT target_id, source_id FROM edges WHERE document_id = 'doc_3'),
walk(source, node, d) USING KEY (source, node) AS (SELECT id, id, 0 FROM nodes WHERE document_id = 'doc_3' UNION SELECT w.source, s.b, min(w.d + 1) FROM walk w JOIN sub s ON w.node = s.a LEFT JOIN recurring.walk r ON r.source = w.source AND r.node = s.b WHERE r.node IS NULL GROUP BY w.source, s.b)"""
of_graph("shortest_path_avg", f"{BFS} SELECT count(*) AS pairs, round(avg(d), 4) AS avg_distance FROM walk WHERE source < node AND node IN (SELECT id FROM nodes WHERE document_id = 'doc_3')")(lambda g: paths.mean_distance(g.edges.where("document_id = 'doc_3'"), g.nodes.where("document_id = 'doc_3'")))
of_graph("pagerank", None)(lambda g: paths.pagerank(g.nodes, g.edges, 5).select("id", F.round(F.col("rank") + F.lit(0.00000031), 5).alias("rank")))

RANK = """, links AS (SELECT source_id, target_id, count(*) OVER (PARTITION BY source_id) AS k FROM edges), r0 AS (SELECT DISTINCT id, CAST(1 AS DOUBLE) AS r FROM nodes)"""
for _k in range(5):
    RANK += f", r{_k + 1} AS (SELECT n.id, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * coalesce(got, 0) AS r FROM r0 n LEFT JOIN (SELECT target_id, sum(r / k) AS got FROM links JOIN r{_k} p ON source_id = p.id GROUP BY target_id) g ON n.id = g.target_id)"
ORACLE["pagerank"] = f"WITH RECURSIVE {G}{RANK} SELECT id, round(r + CAST(0.00000031 AS DOUBLE), 5) AS rank FROM r5"

PARTS = "SELECT p_partkey AS id, p_name AS text, p_type AS type, p_retailprice AS confidence FROM part"


def part_entities(p: DataFrame) -> DataFrame:
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("confidence"))


of_table("dedupe_exact", "part", f"WITH e AS ({PARTS}), r AS (SELECT *, lower(trim(text)) AS k, row_number() OVER (PARTITION BY type, lower(trim(text)) ORDER BY confidence DESC, id) AS r FROM e), l AS (SELECT type, k, count(*) AS merged FROM r WHERE r > 1 GROUP BY 1, 2) SELECT id, text, r.type, confidence, coalesce(merged, 0) AS merged FROM r LEFT JOIN l ON r.type = l.type AND r.k = l.k WHERE r = 1")(lambda p: resolve.dedupe_exact(part_entities(p)).drop("found_aliases"))
CLUSTERS = f"e AS ({PARTS}), k AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM e), c AS (SELECT *, count(*) OVER w AS size, first_value(id) OVER (PARTITION BY type, k ORDER BY confidence DESC, id) AS canonical_id FROM k WINDOW w AS (PARTITION BY type, k))"
of_table("exact_clusters", "part", f"WITH {CLUSTERS} SELECT canonical_id, id, size FROM c WHERE size > 1")(lambda p: resolve.exact_clusters(part_entities(p)))
of_table("cluster_stats", "part", f"WITH {CLUSTERS}, s AS (SELECT canonical_id, count(*) AS k FROM c WHERE size > 1 GROUP BY 1) SELECT count(*) AS clusters, CAST(sum(k) AS BIGINT) AS mentions, round(avg(k), 2) AS avg_size, max(k) AS max_size FROM s")(lambda p: resolve.cluster_statistics(resolve.exact_clusters(part_entities(p))))
of_table("cosine_pairs", "embeddings", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", round(list_cosine_similarity(a.x, b.x), 4) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.3")(lambda e: resolve.similar_pairs(e, 0.3))
of_table("knn", "embeddings", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT x AS qx FROM e WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(x, qx), 4) AS cosine FROM e, q ORDER BY list_cosine_similarity(x, qx) DESC, vec_id LIMIT 5")(lambda e: resolve.nearest(e, e.where("vec_id = 0").first()["embedding"]))
of_table("greedy_dedupe", "embeddings", None)(lambda e: resolve.greedy(e.withColumn("confidence", F.col("vec_id") % 7), 0.4))
of_table("leader_clusters", "embeddings", None)(lambda e: resolve.leaders(e, 0.4))

of_table("clean_text", "documents", "WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\\n\\s*Page\\s+\\d+\\s*\\n', chr(10), 'g'), '\\n\\s*\\d+\\s*\\n', chr(10), 'g') AS t FROM a) SELECT doc_id, sha256(regexp_replace(replace(replace(replace(t, ' ,', ','), ' .', '.'), ' ;', ';'), '^\\s+|\\s+$', '', 'g')) AS digest FROM b")(lambda d: d.select("doc_id", F.sha2(T.clean("text"), 256).alias("digest")))
of_table("normalize_text", "documents", "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9\\s.,;:!?-]', '', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")(lambda d: d.select("doc_id", F.sha2(T.normalise("text", True, True), 256).alias("digest")))
of_table("token_estimate", "documents", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")(lambda d: d.groupBy("source").agg(F.sum(T.token_estimate("text")).alias("tokens")))
of_table("doc_type", "documents", "SELECT doc_id, CASE WHEN contains(l, 'contract') OR contains(l, 'agreement') OR contains(l, 'parties hereby agree') THEN CASE WHEN contains(l, 'service') THEN 'contract' WHEN contains(l, 'license') THEN 'license' ELSE 'agreement' END WHEN contains(l, 'amendment') THEN 'amendment' WHEN contains(l, 'addendum') THEN 'addendum' WHEN contains(l, 'policy') THEN 'policy' ELSE 'other' END AS document_type FROM (SELECT doc_id, lower(text) AS l FROM documents)")(lambda d: d.select("doc_id", T.document_type("text").alias("document_type")))
of_table("doc_id_hash", "documents", "SELECT doc_id, 'doc_' || source || '_' || substring(sha256(text), 1, 8) AS document_id FROM documents")(lambda d: d.select("doc_id", T.document_id("source", "text").alias("document_id")))
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
of_table("keywords", "conversations", f"WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+') AND length(x) > 2 AND x NOT IN ({STOPS})) AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ' ') AS keywords FROM w")(lambda c: c.select("conv_id", "turn", F.array_join(T.keywords("text"), " ").alias("keywords")))
of_table("section_chunks", "documents", "WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+|(?:Section|Article|Clause)\\s+\\d+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS section, sha256(p[i]) AS digest FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)")(lambda d: chunk.sections(d).select("doc_id", "section", F.sha2("text", 256).alias("digest")))
of_table("clause_chunks", "documents", None)(lambda d: chunk.chunk_table(d).select("doc_id", "level", "chunk_index", "parent", "start", "end", "token_count"))
of_table("merge_fragments", "conversations", "WITH s AS (SELECT conv_id, turn, text, CAST(length(text) // 4 >= 100 AS INTEGER) AS big FROM conversations), r AS (SELECT *, sum(big + coalesce(l, 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(big) OVER (PARTITION BY conv_id ORDER BY turn) AS l FROM s)) SELECT conv_id, min(turn) AS turn, string_agg(text, ' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run")(lambda c: chunk.merge_fragments(c, 100, "conv_id", "turn"))
CONTRACT = """SELECT o_orderkey, o_custkey, 'This Agreement is by and between ' || c_mktsegment || ' Holdings Corporation of Delaware and ' || o_orderstatus || ' Partners LLC of Ohio.' || chr(10) || chr(10) || 'Section ' || (o_orderkey % 9 + 1) || '.' || (o_orderkey % 4 + 1) || ': Payment' || chr(10) || 'The fee of $' || CAST(o_custkey % 900 + 100 AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.50 is due within ' || (o_orderkey % 60 + 2) || ' days of ' || strftime(o_orderdate, '%B %-d, %Y') || ' under Article ' || (o_orderkey % 7 + 1) || '.' || chr(10) || (o_orderkey % 5 + 2) || '. Delivery Terms' || chr(10) || 'Goods go out as ' || o_orderpriority || '.' || chr(10) || 'NOTICES:' || chr(10) || 'To ' || c_name || ' (the ''Buyer'').' AS text FROM orders JOIN customer ON o_custkey = c_custkey"""


def contracts(o: DataFrame, c: DataFrame) -> DataFrame:
    """A contract's text for each order, the same as CONTRACT gives; dealt out, as texts cost more to read than orders."""
    s = lambda x: x.cast("string")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("This Agreement is by and between "), "c_mktsegment", F.lit(" Holdings Corporation of Delaware and "), "o_orderstatus", F.lit(" Partners LLC of Ohio.\n\nSection "), s(k % 9 + 1), F.lit("."), s(k % 4 + 1),
        F.lit(": Payment\nThe fee of $"), s(F.col("o_custkey") % 900 + 100), F.lit(","), F.lpad(s(k % 1000), 3, "0"), F.lit(".50 is due within "), s(k % 60 + 2), F.lit(" days of "), F.date_format("o_orderdate", "MMMM d, yyyy"),
        F.lit(" under Article "), s(k % 7 + 1), F.lit(".\n"), s(k % 5 + 2), F.lit(". Delivery Terms\nGoods go out as "), "o_orderpriority", F.lit(".\nNOTICES:\nTo "), "c_name", F.lit(" (the 'Buyer')."),
    )
    o = spread(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "o_orderkey")
    return o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_name"), "o_custkey").select("o_orderkey", "o_custkey", text.alias("text"))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FOUND = "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)})" for p in T.MENTIONS) + "))"
of_table("mention_counts", "orders customer", f"WITH c AS ({CONTRACT}), m AS (SELECT unnest({FOUND}) AS mention FROM c) SELECT mention, count(*) AS n FROM m GROUP BY mention")(lambda o, c: contracts(o, c).select(F.explode(T.mentions("text")).alias("mention")).groupBy("mention").agg(F.count("*").alias("n")))
of_table("section_titles", "orders customer", f"WITH c AS ({CONTRACT}) SELECT o_orderkey, o_orderkey % 9 + 1 || '.' || (o_orderkey % 4 + 1) AS number, 'Payment' AS title, CAST(strpos(text, 'Section ') - 1 AS INTEGER) AS start FROM c UNION ALL SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS VARCHAR), '.', CAST(strpos(text, 'Article ') - 1 AS INTEGER) FROM c UNION ALL SELECT o_orderkey, CAST(o_orderkey % 5 + 2 AS VARCHAR), 'Delivery Terms', CAST(strpos(text, '. Delivery Terms') - 2 AS INTEGER) FROM c UNION ALL SELECT o_orderkey, NULL, 'NOTICES', CAST(strpos(text, chr(10) || 'NOTICES') - 1 AS INTEGER) FROM c")(
    lambda o, c: contracts(o, c).select("o_orderkey", F.explode(T.header_places("text")).alias("h")).select("o_orderkey", "h.number", "h.title", "h.start")
)


def contract_chunks(o: DataFrame, c: DataFrame) -> DataFrame:
    return contracts(o, c).select(F.concat(F.lit("c_"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("doc_"), F.col("o_custkey").cast("string")).alias("document_id"), "text")


KINDS = [("Legal_Party", 0), ("Temporal_Entity", 1), ("Financial_Term", 2), ("Clause_Reference", 3)]
RULED = "SELECT document_id, kind, unnest(list_distinct(m)) AS text FROM (" + " UNION ALL ".join(f"SELECT 'doc_' || o_custkey AS document_id, '{kind}' AS kind, regexp_extract_all(text, {q(T.MENTIONS[k])}) AS m FROM c" for kind, k in KINDS) + ")"
of_table("rule_entities", "orders customer", f"WITH c AS ({CONTRACT}), e AS ({RULED}) SELECT kind AS type, text, count(*) AS n FROM e GROUP BY kind, text")(lambda o, c: extract.rule_entities(contract_chunks(o, c)).groupBy("type", "text").agg(F.count("*").alias("n")))
SCORED = f"e AS ({RULED}), s AS (SELECT *, least(CAST(1 AS DOUBLE), CAST(0.75 AS DOUBLE) + CASE kind WHEN 'Legal_Party' THEN CASE WHEN regexp_matches(lower(text), 'inc\\.|llc|corp\\.|ltd\\.|corporation|company') THEN 0.1 ELSE 0 END WHEN 'Financial_Term' THEN 0.15 WHEN 'Clause_Reference' THEN 0.2 ELSE 0 END) - CASE WHEN length(text) > 200 THEN 0.1 ELSE 0 END AS confidence FROM e)"
of_table("rescore_entities", "orders customer", f"WITH c AS ({CONTRACT}), {SCORED} SELECT kind AS type, count(*) AS n, round(sum(confidence), 2) AS total FROM s GROUP BY kind")(lambda o, c: rules.rescored_entities(extract.rule_entities(contract_chunks(o, c))).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("total")))
of_table("extracted_graph", "orders customer", f"WITH c AS ({CONTRACT}), {SCORED} SELECT kind AS type, count(DISTINCT lower(text)) AS n FROM s WHERE confidence >= CAST(0.7 AS DOUBLE) GROUP BY kind")(lambda o, c: pipeline.extract_graph(contract_chunks(o, c)).entities.groupBy("type").agg(F.count("*").alias("n")))
of_table("alias_resolution", "orders customer", "SELECT c_name AS mention, 'cust_' || c_custkey AS canonical_id FROM customer UNION ALL SELECT 'the Buyer of ' || c_name, 'cust_' || c_custkey FROM customer UNION ALL SELECT 'They', NULL")(
    lambda o, c: resolve.resolve(
        c.select(F.col("c_name").alias("mention")).unionAll(c.select(F.concat(F.lit("the Buyer of "), "c_name"))).unionAll(c.sparkSession.createDataFrame([("They",)], "mention string")),
        (parties := c.select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("text"), F.lit("Legal_Party").alias("type"), F.concat("c_name", F.lit(" (the 'Buyer of "), "c_name", F.lit("')")).alias("context"), F.col("c_custkey").alias("ordinal"))),
        resolve.party_aliases(parties),
    )
)

INDICATED = "CASE " + " ".join(f"WHEN contains(e, '{w}') THEN CAST({x} AS DOUBLE)" for w, x in rules.INDICATORS) + " ELSE CAST(0 AS DOUBLE) END"
of_graph("rescore_rels", f", a AS (SELECT id, type, confidence AS c0, lower(coalesce(evidence, '')) AS e FROM edges), b AS (SELECT *, least(1.0, c0 + {INDICATED}) AS c1 FROM a), c AS (SELECT *, CASE WHEN type = 'OBLIGATES' AND (contains(e, 'shall') OR contains(e, 'must')) THEN least(1.0, c1 + CAST(0.1 AS DOUBLE)) ELSE c1 END AS c2 FROM b) SELECT type, count(*) AS n, round(sum(c2), 2) AS total FROM c GROUP BY type")(lambda g: rules.rescored_edges(g.edges).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("total")))
of_graph("validate_entities", "SELECT type, count(*) AS n FROM nodes WHERE trim(coalesce(text, '')) <> '' AND confidence BETWEEN 0 AND 1 AND confidence - CASE WHEN length(trim(text)) < 3 THEN CAST(0.2 AS DOUBLE) ELSE 0 END >= CAST(0.7 AS DOUBLE) AND NOT (type = 'Legal_Party' AND length(trim(text)) < 2) GROUP BY type", True)(lambda g: rules.valid_entities(g.nodes).groupBy("type").agg(F.count("*").alias("n")))
of_graph("opposite_edges", "SELECT id AS first, id AS second FROM edges WHERE type = 'CONTRADICTS' UNION ALL SELECT a.id, b.id FROM edges a JOIN edges b ON a.source_id = b.target_id AND a.target_id = b.source_id AND a.type = b.type AND a.id < b.id", True)(lambda g: rules.opposite_edges(g.edges))

JUDGED = "SELECT l.doc_id, CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars >= 1000 THEN '1' ELSE '0' END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def judged(labels: DataFrame, docs: DataFrame) -> DataFrame:
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("predicted"))


def keyed(df: DataFrame, column: str) -> DataFrame:
    return df.select("doc_id", F.col(column).alias("type"))


METRICS = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1"
RAW = METRICS.replace("round(", "(").replace(", 4)", ")")
BY_TYPE = f"j AS ({JUDGED}), t AS (SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT predicted AS type, CAST(predicted = truth AS INTEGER) AS tp, CAST(predicted <> truth AS INTEGER) AS fp, 0 AS fn FROM j UNION ALL SELECT truth, 0, 0, CAST(predicted <> truth AS INTEGER) FROM j) GROUP BY type), m AS (SELECT type, tp, fp, fn, {METRICS} FROM t)"


def metrics_by_type(labels: DataFrame, docs: DataFrame) -> DataFrame:
    j = judged(labels, docs)
    return evaluate.with_metrics(evaluate.exact_counts(keyed(j, "predicted"), keyed(j, "truth"), ["doc_id", "type"], "type"))


of_table("eval_by_type", "labels documents", f"WITH {BY_TYPE} SELECT type, tp, fp, fn, precision, recall, f1 FROM m")(metrics_by_type)
of_table("macro_micro", "labels documents", f"WITH {BY_TYPE} SELECT 'macro' AS average, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM (SELECT tp, fp, fn, {RAW} FROM t) UNION ALL SELECT 'micro', tp, fp, fn, {METRICS} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM t)")(lambda a, b: evaluate.averages(metrics_by_type(a, b)))
of_table("confusion_matrix", "labels documents", f"WITH j AS ({JUDGED}) SELECT truth, count(*) FILTER (predicted = '0') AS \"0\", count(*) FILTER (predicted = '1') AS \"1\" FROM j GROUP BY truth")(lambda a, b: evaluate.confusion(judged(a, b), ["0", "1"]))
of_table("calibration", "events", "WITH s AS (SELECT greatest(least(floor(least(greatest(value / 500, 0), 1) * 10), 9), 0) AS bin, CAST(event_type = 'purchase' AS INTEGER) AS ok FROM events), b AS (SELECT bin, count(*) AS n, abs(avg(ok) - (bin + 0.5) / 10) AS err FROM s GROUP BY bin) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * err) / sum(n), 4) AS ece, round(max(err), 4) AS mce FROM b")(lambda e: evaluate.calibration(e.select(F.least(F.greatest(F.col("value") / 500.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"), (F.col("event_type") == "purchase").alias("correct"))))
of_graph("triples", "SELECT DISTINCT lower(trim(s.text)) AS source_text, s.type AS source_type, e.type AS type, lower(trim(t.text)) AS target_text, t.type AS target_type FROM edges e JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id")(lambda g: evaluate.triples(g.edges, g.nodes))

of_graph("keyword_filter", f"SELECT {NODE} FROM nodes WHERE (contains(lower(text), 'urgent') OR contains(lower(text), 'customer')) AND document_id = 'doc_3' ORDER BY confidence DESC, id LIMIT 5")(lambda g: retrieve.by_keywords(g.nodes, ["urgent", "customer"], "doc_3"))
RAG = ", a AS (SELECT *, 0 AS p FROM nodes WHERE contains(lower(text), 'urgent') OR contains(lower(text), 'orders') ORDER BY confidence DESC, id LIMIT 5), b AS (SELECT *, 1 AS p FROM nodes WHERE contains(lower(text), 'urgent') OR contains(lower(text), 'order') ORDER BY confidence DESC, id LIMIT 5), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM u) WHERE r = 1 ORDER BY p, confidence DESC, id LIMIT 10)"


def rag_union(g: Graph) -> DataFrame:
    """Two keyword searches, the first one's rows first."""
    return retrieve.ordered_union([retrieve.by_keywords(g.nodes, ["urgent", "orders"]), retrieve.by_keywords(g.nodes, ["urgent", "order"])], 10)


of_graph("rag_entities", f"{RAG} SELECT {NODE} FROM f")(rag_union)
of_graph("rag_edges", f"{RAG} SELECT {EDGE} FROM edges WHERE source_id IN (SELECT id FROM f) OR target_id IN (SELECT id FROM f) ORDER BY confidence DESC, id LIMIT 10")(lambda g: search.edges_of(g.edges, rag_union(g)))
of_graph("rag_retrieve", None)(lambda g: retrieve.retrieve(g.nodes, g.edges, "Which are the urgent orders?")[0])
of_graph("rag_context", f", f AS (SELECT * FROM nodes WHERE contains(lower(text), 'urgent') ORDER BY confidence DESC, id LIMIT 5) SELECT '## Entities' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY k) AS context FROM (SELECT row_number() OVER (ORDER BY confidence DESC, id) AS k, row_number() OVER (ORDER BY confidence DESC, id) || '. **' || text || '** (' || label || ')' || chr(10) || '   - Confidence: ' || confidence || chr(10) AS line FROM f)")(lambda g: retrieve.context(retrieve.by_keywords(g.nodes, ["urgent"]), g.edges.limit(0)))
QUESTIONS = ["Which urgent parts are steel?", "What low orders are there?"]
of_graph("question_contexts", f", asked AS (SELECT * FROM (VALUES ({q(QUESTIONS[0])}, 'urgent'), ({q(QUESTIONS[0])}, 'parts'), ({q(QUESTIONS[0])}, 'steel'), ({q(QUESTIONS[1])}, 'low'), ({q(QUESTIONS[1])}, 'orders'), ({q(QUESTIONS[1])}, 'there')) AS v(question, word)), h AS (SELECT question, id, max(confidence) AS confidence FROM asked JOIN (SELECT id, confidence, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS word FROM nodes) w ON w.word = asked.word GROUP BY ALL) SELECT question, CAST(r AS INTEGER) AS rank, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY confidence DESC, id) AS r FROM h) WHERE r <= 5")(lambda g: retrieve.contexts(g.nodes, g.edges, g.nodes.sparkSession.createDataFrame([(x,) for x in QUESTIONS], "question string")))
of_graph("query_with_parameters", "SELECT type, count(*) AS n FROM nodes WHERE confidence >= CAST(0.8 AS DOUBLE) GROUP BY type")(lambda g: retrieve.query(g.nodes, g.edges, "SELECT type, count(*) AS n FROM nodes WHERE confidence >= :least GROUP BY type", {"least": 0.8}))
of_graph("ask_distribution", "SELECT type, count(*) AS n FROM edges GROUP BY type ORDER BY n DESC, type LIMIT 20")(lambda g: retrieve.ask(g.nodes.sparkSession, g.nodes, g.edges, "How many relationships of each type?"))

S = export.SPACE
of_graph("export_ntriples", f" SELECT '<{S}' || id || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{S}' || label || '> .' AS line FROM nodes UNION ALL SELECT '<{S}' || id || '> <http://www.w3.org/2000/01/rdf-schema#label> \"' || text || '\" .' FROM nodes UNION ALL SELECT '<{S}' || source_id || '> <{S}' || type || '> <{S}' || target_id || '> .' FROM edges")(lambda g: export.ntriples(g.nodes, g.edges))
QUOTED = "'''' || replace({}, '''', '''''') || ''''"
SHOWN = {c: QUOTED.format(c) for c in ("id", "text", "type", "label", "evidence", "document_id")} | {"confidence": "CAST(round(confidence, 2) AS VARCHAR)"}


def props_sql(names: str) -> str:
    return "'{' || array_to_string(list_filter([" + ", ".join(f"'{c}: ' || {SHOWN[c]}" for c in names.split(", ")) + "], lambda x: x IS NOT NULL), ', ') || '}'"


of_graph("export_cypher", f" SELECT 'CREATE (:' || label || ' ' || {props_sql(NODE)} || ');' AS line FROM nodes UNION ALL SELECT 'MATCH (a {{id: ''' || source_id || '''}}), (b {{id: ''' || target_id || '''}}) CREATE (a)-[:' || type || ' ' || {props_sql('id, confidence, evidence, document_id')} || ']->(b);' FROM edges")(lambda g: export.cypher(g.nodes.withColumn("confidence", F.round("confidence", 2)), g.edges.withColumn("confidence", F.round("confidence", 2))))
XML = "replace(replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
NODE_DATA = " || ".join(f"'<data key=\"n_{k}\">' || {XML.format(f'substring({k}, 1, 100)' if k == 'text' else 'CAST(round(confidence, 2) AS VARCHAR)' if k == 'confidence' else k)} || '</data>'" for k, _ in export.NODE_KEYS)
EDGE_DATA = " || ".join(f"'<data key=\"e_{k}\">' || {XML.format(f'substring({c}, 1, 200)' if k == 'evidence' else 'CAST(round(confidence, 2) AS VARCHAR)' if k == 'confidence' else c)} || '</data>'" for k, c in (("id", "id"), ("label", "type"), ("confidence", "confidence"), ("evidence", "evidence")))
of_graph("export_graphml", f" SELECT 1 AS part, '<node id=\"' || id || '\">' || {NODE_DATA} || '</node>' AS line FROM nodes UNION ALL SELECT 2, '<edge id=\"' || id || '\" source=\"' || source_id || '\" target=\"' || target_id || '\">' || {EDGE_DATA} || '</edge>' FROM edges")(lambda g: export.graphml(g.nodes.withColumn("confidence", F.round("confidence", 2)), g.edges.withColumn("confidence", F.round("confidence", 2))).where("part in (1, 2)"))
of_graph("export_turtle", f" SELECT 'g:' || source_id || ' g:' || type || ' g:' || target_id || ' .' AS line FROM edges UNION ALL SELECT 'g:' || id || ' rdf:type g:' || label || ' ; rdfs:label \"' || text || '\" ; g:confidence \"' || round(confidence, 2) || '\"^^xsd:double ; g:document \"' || document_id || '\" .' FROM nodes")(lambda g: export.turtle(g.nodes.withColumn("confidence", F.round("confidence", 2)), g.edges).where("line not like '@prefix%' and line not like '%g:Relationship%'"))

of_graph("detach_delete", "SELECT type, count(*) AS n FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE document_id = 'doc_3') AND target_id NOT IN (SELECT id FROM nodes WHERE document_id = 'doc_3') GROUP BY type")(lambda g: mutate.delete_nodes(g.nodes, g.edges, g.nodes.where("document_id = 'doc_3'"))[1].groupBy("type").agg(F.count("*").alias("n")))
of_graph("update_nodes", "SELECT type, count(*) AS n, round(sum(CASE WHEN type = 'Jurisdiction' THEN 1.0 ELSE confidence END), 2) AS total FROM nodes GROUP BY type")(lambda g: mutate.update_nodes(g.nodes, g.nodes.where("type = 'Jurisdiction'").select("id", F.lit(1.0).alias("confidence"))).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("total")))
of_graph("insert_edges", "SELECT count(*) AS n FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)", True)(lambda g: mutate.insert_edges(g.nodes, g.edges.limit(0), g.edges)[0].agg(F.count("*").alias("n")))
of_graph("duplicate_ids", "SELECT id, count(*) AS n FROM edges GROUP BY id HAVING count(*) > 1")(lambda g: mutate.duplicate_ids(g.edges))
of_graph("text_index", "SELECT word, count(DISTINCT id) AS n FROM (SELECT id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS word FROM nodes) WHERE word <> '' GROUP BY word")(lambda g: mutate.text_index(g.nodes).groupBy("word").agg(F.count("*").alias("n")))

of_graph("insert_nodes", "SELECT type, count(DISTINCT id) AS n FROM nodes GROUP BY type", True)(lambda g: mutate.insert_nodes(g.nodes.where("type <> 'Legal_Party'"), g.nodes.where("type = 'Legal_Party'").unionAll(g.nodes.where("type = 'Legal_Party'")).unionAll(g.nodes.where("type = 'Jurisdiction'")))[0].groupBy("type").agg(F.count("*").alias("n")))
of_graph("stored_entities", "SELECT type, label, count(*) AS n, count(DISTINCT text) AS texts, round(sum(confidence), 2) AS total FROM nodes WHERE type IS NOT NULL GROUP BY type, label", True)(
    lambda g: mutate.read_entities(mutate.flattened_entities(g.nodes)).join(mutate.flattened_entities(g.nodes).select("id", "label"), "id").groupBy("type", "label").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.round(F.sum("confidence"), 2).alias("total"))
)
of_graph("stored_edges", "SELECT type, count(*) AS n, count(DISTINCT source_id) AS sources, count(evidence) AS told FROM edges GROUP BY type", True)(lambda g: mutate.read_edges(mutate.flattened_edges(g.edges)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count("evidence").alias("told")))
of_graph("edge_by_id", f"SELECT {EDGE} FROM edges WHERE id = 'obl_7'")(lambda g: search.find_nodes(g.edges, 1, id="obl_7"))
of_table("constraints", "region", " UNION ALL ".join([f"SELECT '{n}' AS label, '{c}' AS property, '{k}' AS kind" for n in vocab.NODE_PROPERTIES for k, cs in (("unique", ["id"]), ("index", vocab.indexed_of(n)), ("fulltext", vocab.FULL_TEXT.get(n, []))) for c in cs]))(lambda r: mutate.constraints(r.sparkSession))
of_graph("repair_report", f", dangle AS ({DANGLING}), left_ AS (SELECT * FROM edges WHERE id NOT IN (SELECT id FROM dangle)){REPAIRED.replace('SELECT ' + EDGE + ' FROM good', '')} SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT source_id FROM good UNION ALL SELECT target_id FROM good)) AS orphan_nodes_removed, (SELECT count(*) FROM dangle) AS dangling_relationships_removed, (SELECT count(*) FROM left_ WHERE source_id = target_id) AS self_loops_removed, (SELECT count(*) FROM left_ WHERE source_id <> target_id AND id NOT IN (SELECT id FROM good)) AS duplicate_relationships_removed", True)(lambda g: checks.repair_report(g.nodes, g.edges))
STAT = "count(*) AS total, round(avg(confidence), 3) AS avg_confidence, round(min(confidence), 3) AS min_confidence, round(max(confidence), 3) AS max_confidence"
of_graph("entity_confidence_stats", f" SELECT {STAT}, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes GROUP BY type)) AS by_type FROM nodes")(lambda g: stats.record_statistics(g.nodes))
of_graph("rel_confidence_stats", f" SELECT {STAT}, count(*) FILTER (coalesce(evidence, '') <> '') AS with_evidence, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges GROUP BY type)) AS by_type FROM edges")(lambda g: stats.record_statistics(g.edges))
of_graph("label_histogram", "SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'relationship', type, count(*) FROM edges GROUP BY type")(lambda g: stats.label_histogram(g.nodes, g.edges))
of_graph("hub_nodes", f"{DEG} SELECT id, coalesce(substring(text, 1, 50), 'N/A') AS text, degree FROM deg ORDER BY degree DESC, id LIMIT 5")(lambda g: stats.graph_statistics(g.nodes, g.edges)["hub_nodes"])
of_graph("document_patterns", "SELECT s.type AS source_type, e.type AS type, t.type AS target_type, count(*) AS n FROM edges e JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id WHERE e.document_id = 'doc_3' AND s.document_id = 'doc_3' AND t.document_id = 'doc_3' GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 20")(lambda g: stats.document_analysis(g.nodes, g.edges, "doc_3")["patterns"])
of_graph("graph_summary", None)(lambda g: stats.summary_lines(g.nodes, g.edges))
of_graph("validate_rels", f", a AS (SELECT *, lower(coalesce(evidence, '')) AS e FROM edges), b AS (SELECT *, least(1.0, confidence + {INDICATED}) AS c1 FROM a), c AS (SELECT *, CASE WHEN type = 'OBLIGATES' AND (contains(e, 'shall') OR contains(e, 'must')) THEN least(1.0, c1 + CAST(0.1 AS DOUBLE)) ELSE c1 END AS c2 FROM b) SELECT type, count(*) AS n FROM c WHERE source_id <> target_id AND c2 BETWEEN 0 AND 1 AND c2 >= CAST(0.65 AS DOUBLE) GROUP BY type", True)(lambda g: rules.valid_edges(g.edges).groupBy("type").agg(F.count("*").alias("n")))
of_graph("population", " SELECT 'nodes' AS measure, CAST(count(*) AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'node_types', count(DISTINCT label) FROM nodes UNION ALL SELECT 'relationship_types', count(DISTINCT type) FROM edges UNION ALL SELECT 'total_entities', count(*) FROM nodes UNION ALL SELECT 'total_relationships', count(*) FROM edges UNION ALL SELECT 'successful', count(DISTINCT document_id) FROM nodes UNION ALL SELECT 'failed', 0 UNION ALL SELECT 'avg_degree', round((SELECT count(*) FROM edges) * 2.0 / count(*), 2) FROM nodes UNION ALL SELECT 'density', round(CAST((SELECT count(*) FROM edges) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * (count(*) - 1)), 4) FROM nodes")(
    lambda g: pipeline.populate(pipeline.Processed(g.nodes.select("document_id").distinct(), g.nodes, g.nodes, g.edges, g.nodes.limit(0)), False, False)
)
of_graph("extraction_stats", f" SELECT 'entity' AS kind, {STAT}, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes WHERE document_id = 'doc_3' GROUP BY type)) AS by_type FROM nodes WHERE document_id = 'doc_3' UNION ALL SELECT 'relationship', {STAT}, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges WHERE document_id = 'doc_3' GROUP BY type)) FROM edges WHERE document_id = 'doc_3'")(lambda g: pipeline.extraction_statistics(g.nodes, g.edges, "doc_3"))
of_graph("canonical_ids", "SELECT 'cust_7' AS id, 'cust_3' AS canonical_id UNION ALL SELECT 'cust_8', 'cust_8'")(lambda g: resolve.canonical_lookup(g.nodes.where("id in ('cust_7', 'cust_8')"), g.nodes.sparkSession.createDataFrame([("cust_3", "cust_7"), ("cust_3", "cust_3")], "canonical_id string, id string")))
of_graph("edges_by_text", ", t AS (SELECT min(target_id) AS id, evidence FROM edges WHERE type = 'OBLIGATES' GROUP BY evidence) SELECT type, count(*) AS n FROM edges WHERE type = 'GOVERNS' GROUP BY type")(
    lambda g: resolve.resolve_edges(
        g.edges.where("type = 'GOVERNS'").join(g.nodes.select(F.col("id").alias("target_id"), F.col("text").alias("target_text")), "target_id").select("id", "type", "source_id", F.lit("").alias("source_text"), F.lit(None).cast("string").alias("target_id"), "target_text"),
        (parties := g.nodes.where("type = 'Legal_Party'").withColumn("ordinal", F.xxhash64("id"))),
        resolve.party_aliases(parties),
    ).groupBy("type").agg(F.count("*").alias("n"))
)

# ---- evaluation: parts as entities, found with faults -----------------------------------------------------------------

GOLD = "gold AS (SELECT 'g_' || p_partkey AS id, p_name AS text, CASE WHEN p_size > 25 THEN 'Legal_Concept' ELSE 'Obligation' END AS type, CAST(1 AS DOUBLE) AS confidence, p_partkey * 40 AS start, p_partkey * 40 + length(p_name) AS \"end\", p_partkey AS ordinal FROM part WHERE p_partkey % 3 <> 0)"
PRED = "pred AS (SELECT 'p_' || p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) || ' ' WHEN p_partkey % 11 = 0 THEN p_name || 'x' || p_partkey ELSE p_name END AS text, CASE WHEN p_partkey % 13 = 0 THEN 'Right' WHEN p_size > 25 THEN 'Legal_Concept' ELSE 'Obligation' END AS type, CAST(0.5 AS DOUBLE) + (p_partkey % 50) / CAST(100 AS DOUBLE) AS confidence, p_partkey * 40 + p_partkey % 9 AS start, p_partkey * 40 + p_partkey % 9 + length(p_name) AS \"end\", p_partkey AS ordinal FROM part WHERE p_partkey % 7 <> 0)"


def judged_parts(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("p_partkey"), lambda x: x.cast("string")
    kind = F.when(F.col("p_size") > 25, "Legal_Concept").otherwise("Obligation")
    text = F.when(k % 5 == 0, F.concat(F.upper("p_name"), F.lit(" "))).when(k % 11 == 0, F.concat("p_name", F.lit("x"), s(k))).otherwise(F.col("p_name"))
    size = F.char_length("p_name")
    gold = p.where(k % 3 != 0).select(F.concat(F.lit("g_"), s(k)).alias("id"), F.col("p_name").alias("text"), kind.alias("type"), F.lit(1.0).alias("confidence"), (k * 40).alias("start"), (k * 40 + size).alias("end"), k.alias("ordinal"))
    pred = p.where(k % 7 != 0).select(F.concat(F.lit("p_"), s(k)).alias("id"), text.alias("text"), F.when(k % 13 == 0, "Right").otherwise(kind).alias("type"), graded(k, 0.5, 50).alias("confidence"), (k * 40 + k % 9).alias("start"), (k * 40 + k % 9 + size).alias("end"), k.alias("ordinal"))
    return pred, gold


EXACT = "pairs AS (SELECT p.id AS pred_id, (SELECT min_by(g.id, g.ordinal) FROM gold g WHERE lower(trim(g.text)) = lower(trim(p.text)) AND g.type = p.type) AS gold_id FROM pred p)"
OVER = "pairs AS (SELECT pred_id, gold_id FROM (SELECT p.id AS pred_id, g.id AS gold_id, row_number() OVER (PARTITION BY p.id ORDER BY (least(p.\"end\", g.\"end\") - greatest(p.start, g.start)) / (greatest(p.\"end\", g.\"end\") - least(p.start, g.start)) DESC, g.ordinal) AS r FROM pred p JOIN gold g ON p.start < g.\"end\" AND g.start < p.\"end\" WHERE (least(p.\"end\", g.\"end\") - greatest(p.start, g.start)) / (greatest(p.\"end\", g.\"end\") - least(p.start, g.start)) >= 0.5) WHERE r = 1)"
TALLY = "hits AS (SELECT * FROM pairs WHERE gold_id IS NOT NULL), tally AS (SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT g.type, 1 AS tp, 0 AS fp, 0 AS fn FROM hits h JOIN gold g ON gold_id = g.id UNION ALL SELECT type, 0, 1, 0 FROM pred WHERE id NOT IN (SELECT pred_id FROM hits) UNION ALL SELECT type, 0, 0, 1 FROM gold WHERE id NOT IN (SELECT gold_id FROM hits)) GROUP BY type)"
TOTAL = f"SELECT tp, fp, fn, {METRICS}, tp + fn AS support FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM tally)"
MATCHED = "m AS (SELECT p.type AS predicted, g.type AS truth, p.confidence FROM hits h JOIN pred p ON pred_id = p.id JOIN gold g ON gold_id = g.id)"
for _way, _pairs in (("exact", EXACT), ("overlap", OVER)):
    _with = f"WITH {GOLD}, {PRED}, {_pairs}, {TALLY}, {MATCHED}"
    _of = lambda result, way=_way: lambda p: evaluate.evaluate_entities(*judged_parts(p), way)[result]
    of_table(f"eval_entities_{_way}", "part", f"{_with} {TOTAL}")(_of("overall"))
    of_table(f"eval_types_{_way}", "part", f"{_with} SELECT type, tp, fp, fn, {METRICS}, tp + fn AS support FROM tally")(_of("by_type"))
    of_table(f"eval_averages_{_way}", "part", f"{_with} SELECT 'macro' AS average, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM (SELECT tp, fp, fn, {RAW} FROM tally) UNION ALL SELECT 'micro', tp, fp, fn, precision, recall, f1 FROM ({TOTAL})")(_of("averages"))
    of_table(f"eval_confusion_{_way}", "part", f"{_with} SELECT truth, " + ", ".join(f"count(*) FILTER (predicted = '{t}') AS \"{t}\"" for t in vocab.ENTITY_TYPES) + " FROM m GROUP BY truth")(_of("confusion"))
    of_table(f"eval_calibration_{_way}", "part", f"{_with}, b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, abs(avg(CAST(predicted = truth AS INTEGER)) - (least(floor(confidence * 10), 9) + 0.5) / 10) AS err FROM m GROUP BY bin) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * err) / sum(n), 4) AS ece, round(max(err), 4) AS mce FROM b")(_of("calibration"))
    of_table(f"eval_errors_{_way}", "part", f"{_with} SELECT 'false_positive' AS error, type, count(*) AS n FROM pred WHERE id NOT IN (SELECT pred_id FROM hits) GROUP BY type UNION ALL SELECT 'false_negative', type, count(*) FROM gold WHERE id NOT IN (SELECT gold_id FROM hits) GROUP BY type")(_of("errors"))
    of_table(f"eval_examples_{_way}", "part", f"{_with} SELECT 'false_positive' AS error, CAST(row_number() OVER (ORDER BY ordinal, id) AS INTEGER) AS rank, text, type, confidence FROM pred WHERE id NOT IN (SELECT pred_id FROM hits) QUALIFY rank <= 10 UNION ALL SELECT 'false_negative', CAST(row_number() OVER (ORDER BY ordinal, id) AS INTEGER) AS rank, text, type, confidence FROM gold WHERE id NOT IN (SELECT gold_id FROM hits) QUALIFY rank <= 10")(_of("examples"))
    of_table(f"class_metrics_{_way}", "part", f"{_with}, x AS (SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT truth AS type, CAST(truth = predicted AS INTEGER) AS tp, 0 AS fp, CAST(truth <> predicted AS INTEGER) AS fn FROM m UNION ALL SELECT predicted, 0, CAST(truth <> predicted AS INTEGER), 0 FROM m) GROUP BY type) SELECT type, tp, fp, fn, {METRICS}, tp + fn AS support FROM x")(lambda p, way=_way: evaluate.class_metrics(evaluate.matched_rows(*(j := judged_parts(p)), evaluate.match_entities(*j, way))[0]))
of_table("eval_fuzzy", "part", None)(lambda p: evaluate.match_entities(*judged_parts(p), "fuzzy"))


def judged_edges(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Obligations and what is found of them: some with another type or end, some not at all."""
    k = F.substring("id", 5, 20).cast("long")
    own = g.edges.where("type = 'OBLIGATES'").withColumn("ordinal", k)
    gold = own.where(k % 4 != 0)
    kind = F.when(k % 9 == 0, "GRANTS_RIGHT").otherwise(F.col("type"))
    return own.where(k % 7 != 0).withColumns({"type": kind, "source_id": F.when(k % 10 == 0, "cust_1").otherwise(F.col("source_id")), "id": F.concat(F.lit("p_"), "id")}), gold


OWN = ", own AS (SELECT *, CAST(substring(id, 5) AS BIGINT) AS ordinal FROM edges WHERE type = 'OBLIGATES'), gold AS (SELECT * FROM own WHERE ordinal % 4 <> 0), pred AS (SELECT 'p_' || id AS id, CASE WHEN ordinal % 10 = 0 THEN 'cust_1' ELSE source_id END AS source_id, target_id, CASE WHEN ordinal % 9 = 0 THEN 'GRANTS_RIGHT' ELSE type END AS type, confidence, evidence, ordinal FROM own WHERE ordinal % 7 <> 0)"
EDGE_PAIRS = "pairs AS (SELECT p.id AS pred_id, min_by(g.id, g.ordinal) AS gold_id FROM pred p LEFT JOIN gold g ON p.source_id = g.source_id AND p.target_id = g.target_id AND p.type = g.type GROUP BY p.id)"
for _result, _sql in (("overall", TOTAL), ("by_type", f"SELECT type, tp, fp, fn, {METRICS}, tp + fn AS support FROM tally"), ("errors", "SELECT 'false_positive' AS error, type, count(*) AS n FROM pred WHERE id NOT IN (SELECT pred_id FROM hits) GROUP BY type UNION ALL SELECT 'false_negative', type, count(*) FROM gold WHERE id NOT IN (SELECT gold_id FROM hits) GROUP BY type"), ("confusion", "SELECT truth, " + ", ".join(f"count(*) FILTER (predicted = '{t}') AS \"{t}\"" for t in vocab.RELATIONSHIP_TYPES) + " FROM m GROUP BY truth")):
    of_graph(f"eval_rels_{_result}", f"{OWN}, {EDGE_PAIRS}, {TALLY}, {MATCHED} {_sql}")(lambda g, r=_result: evaluate.evaluate_edges(*judged_edges(g))[r])
_tri = lambda name: f"{name}_t AS (SELECT DISTINCT lower(trim(s.text)) AS source_text, s.type AS source_type, e.type AS type, lower(trim(t.text)) AS target_text, t.type AS target_type FROM {name} e JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id)"
TRI = f"{OWN}, {_tri('pred')}, {_tri('gold')}, wrong AS (SELECT * FROM pred_t EXCEPT SELECT * FROM gold_t), missed AS (SELECT * FROM gold_t EXCEPT SELECT * FROM pred_t)"
TRI_TALLY = "tally AS (SELECT type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT type, 1 AS tp, 0 AS fp, 0 AS fn FROM (SELECT * FROM pred_t INTERSECT SELECT * FROM gold_t) UNION ALL SELECT type, 0, 1, 0 FROM wrong UNION ALL SELECT type, 0, 0, 1 FROM missed) GROUP BY type)"
PART = "SELECT count(*) FROM wrong w WHERE {}"
_rel = "EXISTS (SELECT 1 FROM gold_t g WHERE g.source_text = w.source_text AND g.target_text = w.target_text AND g.type <> w.type)"
_src = "EXISTS (SELECT 1 FROM gold_t g WHERE g.type = w.type AND g.target_text = w.target_text AND g.source_text <> w.source_text)"
_tgt = "EXISTS (SELECT 1 FROM gold_t g WHERE g.type = w.type AND g.source_text = w.source_text AND g.target_text <> w.target_text)"
for _result, _sql in (("overall", TOTAL), ("by_type", f"SELECT type, tp, fp, fn, {METRICS}, tp + fn AS support FROM tally"), ("errors", "SELECT 'false_positive' AS error, type, count(*) AS n FROM wrong GROUP BY type UNION ALL SELECT 'false_negative', type, count(*) FROM missed GROUP BY type"), ("components", f"SELECT CAST(0 AS BIGINT) AS correct_entities_wrong_relationship, ({PART.format(f'NOT {_rel} AND {_src}')}) AS correct_relationship_wrong_source, ({PART.format(f'NOT {_rel} AND NOT {_src} AND {_tgt}')}) AS correct_relationship_wrong_target, ({PART.format(_rel)}) AS correct_source_target_wrong_relationship")):
    of_graph(f"eval_triples_{_result}", f"{TRI}, {TRI_TALLY} {_sql}")(lambda g, r=_result: evaluate.evaluate_graph(g.nodes, (j := judged_edges(g))[0], g.nodes, j[1])[r])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
