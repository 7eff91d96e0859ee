"""Composition: documents to chunks to a validated, deduplicated graph, as one lazy plan; storing, statistics and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import chunk
from ..lineage import cut
from ..operators import checks, extract, mutate, resolve, rules, stats
from ..sources import files


@dataclass
class Extraction:
    entities: DataFrame
    edges: DataFrame
    rejected: DataFrame


@dataclass
class Processed:
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    edges: DataFrame
    rejects: DataFrame  # files that can't be read: path, fault


def document_chunks(documents: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Chunks of documents (id, content) with ids, parents' ids and the title of the section that they lie in."""
    from ..functions import text as T

    rows = chunk.chunk_table(documents.select(F.col("id").alias("document_id"), F.col("content").alias("text")), size, overlap, "document_id", "text")
    name = lambda k: F.concat(F.col("document_id"), F.lit("_chunk_"), k.cast("string"))
    heads = documents.select(F.col("id").alias("document_id"), T.header_places("content").alias("_heads"))
    before = F.transform(F.filter("_heads", lambda h: (h["start"] <= F.col("start")) & (F.col("start") >= 0)), lambda h: F.struct(h["start"].alias("at"), h["title"].alias("title")))
    last = F.array_max(before)
    out = rows.join(heads, "document_id").withColumn("_last", F.when(F.col("level") > 0, last))
    return out.select(name(F.col("chunk_index")).alias("id"), "document_id", "text", "start", "end", F.col("chunk_index").cast("int").alias("chunk_index"), "level", F.when(F.col("parent").isNotNull(), name(F.col("parent"))).alias("parent_chunk_id"), F.col("_last.title").alias("section_title"), F.col("token_count").cast("int").alias("token_count"))


def extract_graph(chunks: DataFrame, response: str | None = None, dedupe: bool = True, edge_response: str | None = None, coreference: bool = False) -> Extraction:
    """Entities by rules or from recorded answers, rescored and deduplicated; relationships of the surviving entities.

    edge_response: the column that has the recorded relationships, if not response. coreference: ends without an id are found by
    their texts.
    """
    raw = extract.rule_entities(chunks) if response is None else extract.replay_entities(chunks, response)
    scored = rules.rescored_entities(raw)
    fault = rules.entity_fault(F.col("text"), F.col("type"), F.col("confidence"))
    low = F.col("confidence") < vocab.MIN_ENTITY_CONFIDENCE
    rejected = scored.withColumn("fault", F.coalesce(fault, F.when(low, "low confidence"))).where("fault is not null").select("id", "fault")
    good = rules.valid_entities(raw)
    entities = resolve.dedupe_exact(good, "ordinal") if dedupe else good
    if response is None and edge_response is None:
        edges = chunks.sparkSession.createDataFrame([], vocab.EDGES)
    else:
        aliases = resolve.party_aliases(good) if coreference else None
        found = extract.replay_edges(chunks, good, edge_response or response, aliases)
        edges = checks.keep_best(rules.valid_edges(found), ["source_id", "target_id", "type"])
    return Extraction(entities, edges, rejected)


def process(spark: SparkSession, path: str, relationships: bool = True, response: DataFrame | None = None) -> Processed:
    """All documents of a folder in one plan; files that can't be read are rejects. response: recorded answers (id of the chunk,
    response), rules without it. Only levels below the whole text are read for entities."""
    documents, rejects = files.read_documents(spark, path)
    chunks = document_chunks(documents)
    inner = chunks.where("level > 0")
    if response is not None:
        inner = inner.join(response.select("id", "response"), "id", "left")
    found = extract_graph(inner, None if response is None else "response")
    edges = found.edges if relationships else found.edges.limit(0)
    return Processed(documents, chunks, found.entities, edges, rejects)


def store(done: Processed, folder: str) -> dict[str, int]:
    """Writes entities and relationships by document; the numbers of rows written and rejected."""
    entities = cut(done.entities)
    written = mutate.store_entities(entities, f"{folder}/nodes")
    edges, rejected = mutate.store_edges(done.edges, entities, f"{folder}/edges")
    return {"entities": written, "relationships": edges, "rejected_relationships": rejected}


def reprocess(done: Processed, folder: str) -> dict[str, int]:
    """Stores again what these documents give: their former rows go, other documents' stay."""
    entities = cut(done.entities)
    return {"entities": mutate.store_entities(entities, f"{folder}/nodes", "overwrite"), "relationships": mutate.store_edges(done.edges, entities, f"{folder}/edges", "overwrite")[0]}


def extraction_statistics(entities: DataFrame, edges: DataFrame, document_id: str | None = None) -> DataFrame:
    """(kind, total, by_type, average, least and greatest confidence) of entities and relationships, of a document or all."""
    n, e = checks.in_document(entities, edges, document_id)
    of = lambda df, kind: stats.record_statistics(df.select("type", "confidence")).withColumn("kind", F.lit(kind))
    return of(n, "entity").unionByName(of(e, "relationship"))


def populate(done: Processed, disambiguated: bool = True, validated: bool = True) -> DataFrame:
    """(measure, value): what a population run reports: documents, entities, relationships, clusters over documents, issues of the
    checks, and the graph's quality measures."""
    one = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")
    entities = done.entities.withColumn("label", F.coalesce(*(F.when(F.col("type") == t, vocab.label_of(t)) for t in vocab.ENTITY_TYPES), F.lit("Entity")))
    parts = [one(done.documents, "successful"), one(done.rejects, "failed"), one(entities, "total_entities"), one(done.edges, "total_relationships")]
    if disambiguated:
        clusters = resolve.exact_clusters(entities, "ordinal")
        parts += [one(clusters.select("canonical_id").distinct(), "total_clusters"), one(clusters.where("canonical_id <> id"), "merged_entities")]
    if validated:
        parts.append(checks.summary(entities, done.edges).select(F.concat(F.lit("issues_"), "check").alias("measure"), F.col("issues").cast("double").alias("value")))
    basic = stats.basic_counts(entities, done.edges)
    parts += [basic.select(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("nodes", "edges", "avg_degree", "density")]
    parts += [one(entities.select("label").distinct(), "node_types"), one(done.edges.select("type").distinct(), "relationship_types")]
    return reduce(DataFrame.unionByName, parts)


def population_statistics(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The stored graph's statistics, what was extracted, and the checks' issues, by name."""
    return stats.graph_statistics(nodes, edges) | {"extraction": extraction_statistics(nodes, edges), "validation": checks.summary(nodes, edges)}


def structural_edges(documents: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """CONTAINS, MENTIONS and HAS_PARTY: the layers beside the semantic one."""
    edge = lambda df, s, t, k: df.select(F.col(s).alias("source_id"), F.col(t).alias("target_id"), F.lit(k).alias("type"))
    whole = edge(chunks.where("parent_chunk_id is null"), "document_id", "id", "CONTAINS")
    inner = edge(chunks.where("parent_chunk_id is not null"), "parent_chunk_id", "id", "CONTAINS")
    named = edge(entities.where("chunk_id is not null"), "chunk_id", "id", "MENTIONS")
    party = edge(entities.where("type = 'Legal_Party'").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi"), "document_id", "id", "HAS_PARTY")
    return whole.unionAll(inner).unionAll(named).unionAll(party)
