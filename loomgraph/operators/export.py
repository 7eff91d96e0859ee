"""Export lines: N-Triples, Turtle, Cypher, GraphML, JSON. One string column, written as text by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal, property_map, quoted, uri

SPACE = "http://example.org/graph/"


def ref(c: Column | str, space: str = SPACE) -> Column:
    return F.concat(F.lit(f"<{space}"), uri(c), F.lit(">"))


def ntriples(nodes: DataFrame, edges: DataFrame, space: str = SPACE) -> DataFrame:
    text = lambda c: F.concat(F.lit('"'), literal(c), F.lit('"'))
    line = lambda s, p, o: F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" ."))
    told = nodes.select(F.explode(F.array(line(ref("id"), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"), ref("label")), line(ref("id"), F.lit("<http://www.w3.org/2000/01/rdf-schema#label>"), text(F.coalesce("text", F.lit("")))))).alias("line"))
    return told.unionAll(edges.select(line(ref("source_id"), ref("type"), ref("target_id")).alias("line")))


def turtle(nodes: DataFrame, edges: DataFrame, space: str = SPACE) -> DataFrame:
    """Valid Turtle with prefixes: each node with its label (cut at 100 characters), type, confidence and document; each
    relationship as a triple and as a resource with its confidence and evidence."""
    head = nodes.sparkSession.createDataFrame([(f"@prefix g: <{space}> .",), ("@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .",), ("@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .",), ("@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .",)], "line string")
    name = lambda c: F.concat(F.lit("g:"), uri(c))
    text = lambda c: F.concat(F.lit('"'), literal(c), F.lit('"'))
    number = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"^^xsd:double'))
    stated = lambda subject, parts: F.concat(subject, F.lit(" "), F.array_join(F.array_compact(F.array(*parts)), " ; "), F.lit(" .")).alias("line")
    told = nodes.select(stated(name("id"), [F.concat(F.lit("rdf:type "), name("label")), F.concat(F.lit("rdfs:label "), text(F.substring("text", 1, 100))), F.concat(F.lit("g:confidence "), number("confidence")), F.concat(F.lit("g:document "), text("document_id"))]))
    evidence = [F.concat(F.lit("g:evidence "), text("evidence"))] if "evidence" in edges.columns else []
    ends = edges.withColumns({"_id": name("id"), "_source": name("source_id"), "_target": name("target_id"), "_kind": name("type")})  # once for both lines
    plain = F.concat(F.col("_source"), F.lit(" "), F.col("_kind"), F.lit(" "), F.col("_target"), F.lit(" ."))
    whole = stated(F.col("_id"), [F.lit("rdf:type g:Relationship"), F.concat(F.lit("g:source "), F.col("_source")), F.concat(F.lit("g:target "), F.col("_target")), F.concat(F.lit("g:kind "), text("type")), F.concat(F.lit("g:confidence "), number("confidence")), *evidence])
    return head.unionAll(told).unionAll(ends.select(F.explode(F.array(plain, whole)).alias("line")))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements that make the graph again, with all properties; nulls are left out."""

    def props(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
        plain = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
        shown = lambda c, kind: quoted(c) if kind == "string" else F.col(c).cast("string") if kind in plain else F.to_json(c) if kind.startswith(("array", "map", "struct")) else quoted(F.col(c).cast("string"))
        return property_map([(c, shown(c, kind)) for c, kind in df.dtypes if c not in leave])

    made = nodes.select(F.concat(F.lit("CREATE (:"), F.coalesce("label", F.lit("Entity")), F.lit(" "), props(nodes), F.lit(");")).alias("line"))
    ends = F.concat(F.lit("MATCH (a {id: "), quoted("source_id"), F.lit("}), (b {id: "), quoted("target_id"), F.lit("}) CREATE (a)-[:"))
    linked = edges.select(F.concat(ends, F.coalesce("type", F.lit("REFERENCES")), F.lit(" "), props(edges, ("source_id", "target_id", "type")), F.lit("]->(b);")).alias("line"))
    return made.unionAll(linked)


def xml(c: Column | str) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Attributes of GraphML nodes and edges; texts and evidence are cut as the format's readers expect short labels.
NODE_KEYS = [("id", "string"), ("label", "string"), ("type", "string"), ("text", "string"), ("confidence", "double"), ("document_id", "string")]
EDGE_KEYS = [("id", "string"), ("label", "string"), ("confidence", "double"), ("evidence", "string")]
CUT = {"text": 100, "evidence": 200}


def graphml(nodes: DataFrame, edges: DataFrame, metadata: bool = True) -> DataFrame:
    """(part, line), in order of part: head, nodes, edges, tail. Keys of nodes and edges have names of their own."""
    spark = nodes.sparkSession
    keys = "".join(f'<key id="{kind[0]}_{k}" for="{kind}" attr.name="{k}" attr.type="{t}"/>' for kind, names in (("node", NODE_KEYS), ("edge", EDGE_KEYS)) for k, t in names) if metadata else ""
    head = f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph id="G" edgedefault="directed">'
    fixed = lambda part, s: spark.range(1).select(F.lit(part).alias("part"), F.lit(s).alias("line"))

    def data(df: DataFrame, names: list[tuple[str, str]], prefix: str, of: dict[str, str]) -> list[Column]:
        if not metadata:
            return []
        value = lambda k: F.substring(of.get(k, k), 1, CUT[k]) if k in CUT else F.col(of.get(k, k)).cast("string")
        return [F.concat(F.lit(f'<data key="{prefix}_{k}">'), xml(value(k)), F.lit("</data>")) for k, _ in names if of.get(k, k) in df.columns]

    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml("id"), F.lit('">'), *data(nodes, NODE_KEYS, "n", {}), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge id="'), xml("id"), F.lit('" source="'), xml("source_id"), F.lit('" target="'), xml("target_id"), F.lit('">'), *data(edges, EDGE_KEYS, "e", {"label": "type"}), F.lit("</edge>")).alias("line"))
    return fixed(0, head).unionAll(n).unionAll(e).unionAll(fixed(3, "</graph></graphml>"))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    of = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("line"))
    return of(nodes, "node").unionAll(of(edges, "edge"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files, in order of part if they have one (a single file for formats with a head and a tail is the
    concatenation of the files in order)."""
    if "part" in lines.columns:
        lines = lines.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line")
    lines.write.mode("overwrite").text(path)
