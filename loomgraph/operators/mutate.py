"""Inserts, updates and deletes as new frames; writes are whole tables or partitions by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..lineage import cut


def insert_nodes(nodes: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(all nodes, rejected): an id that is taken is rejected, and of new rows of one id all but the first in order (any, if no
    order is given)."""
    turn = Window.partitionBy("id").orderBy(order) if order else Window.partitionBy("id").orderBy(F.xxhash64(*new.columns))
    ranked = cut(new.withColumn("_turn", F.row_number().over(turn)).join(nodes.select("id", F.lit(True).alias("_taken")).distinct(), "id", "left"))
    good = F.col("_taken").isNull() & (F.col("_turn") == 1)
    return nodes.unionByName(ranked.where(good).select(*nodes.columns)), ranked.where(~good).select(*new.columns)


def insert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all edges, rejected): both ends must be there."""
    end = lambda c: nodes.select(F.col("id").alias(c))
    good = new.join(end("source_id"), "source_id", "left_semi").join(end("target_id"), "target_id", "left_semi").select(*edges.columns)
    return edges.unionByName(good), new.join(good.select("id"), "id", "left_anti")


def update_nodes(nodes: DataFrame, patch: DataFrame, order: str | None = None) -> DataFrame:
    """Columns of patch that aren't null replace those of the node of the same id. Of several patches of an id each column has
    the last value in order (the greatest, if no order is given), so a node stays one row."""
    columns = [c for c in patch.columns if c not in ("id", order)]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order or c).alias("o"), F.col(c).alias("v"))))["v"].alias(f"_{c}")
    out = nodes.join(patch.groupBy("id").agg(*map(last, columns)), "id", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns))


def patch_attributes(nodes: DataFrame, patch: DataFrame, bag: str = "attributes") -> DataFrame:
    """The property bag of the nodes with the entries of patch (id, key, value): new values replace, null removes a key."""
    none = F.array().cast("array<string>")
    new = patch.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "value")))).alias("_new"), F.collect_set("key").alias("_keys"))
    old = F.map_filter(F.coalesce(bag, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.coalesce("_keys", none), k))
    out = nodes.join(new, "id", "left").withColumn(bag, F.map_concat(old, F.coalesce("_new", F.create_map().cast("map<string,string>"))))
    return out.select(*nodes.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes go with all their edges."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def delete_document(df: DataFrame, document_id: str) -> DataFrame:
    return df.where(~F.col("document_id").eqNullSafe(document_id))


def store(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by document; overwrite replaces only the documents that df holds."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def flattened_entities(entities: DataFrame) -> DataFrame:
    """Entities as they are stored: label, place and flat text properties; blank optional ones are null."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    have = lambda c, kind="string": F.col(c) if c in entities.columns else F.lit(None).cast(kind).alias(c)
    label = F.coalesce(*(F.when(F.col("type") == t, vocab.label_of(t)) for t in vocab.ENTITY_TYPES), F.lit("Entity"))
    attributes = F.transform_keys(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("attr_"), k)) if "attributes" in entities.columns else F.create_map().cast("map<string,string>")
    aliases = F.when(F.size("aliases") > 0, F.array_join("aliases", ",")) if "aliases" in entities.columns else F.lit(None).cast("string")
    context = [blank("context")] if "context" in entities.columns else [F.lit(None).cast("string").alias("context")]
    return entities.select("id", "text", "type", label.alias("label"), "confidence", "document_id", have("chunk_id"), *context, have("start", "int").alias("position_start"), have("end", "int").alias("position_end"), attributes.alias("properties"), aliases.alias("aliases"))


def read_entities(stored: DataFrame) -> DataFrame:
    """Stored entities as records again: attributes and aliases unfolded, an unknown type is a concept, places as a struct."""
    own = F.map_filter("properties", lambda k, _: k.startswith("attr_"))
    attributes = F.transform_keys(own, lambda k, _: F.substring(k, 6, 1_000_000))
    place = F.when(F.col("position_start").isNotNull() & F.col("position_end").isNotNull(), F.struct(F.col("position_start").alias("start"), F.col("position_end").alias("end")))
    kind = F.when(F.col("type").isin(vocab.ENTITY_TYPES), F.col("type")).otherwise("Legal_Concept")
    return stored.select("id", "text", kind.alias("type"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), "document_id", "chunk_id", "context", place.alias("position"), attributes.alias("attributes"), F.when(F.coalesce("aliases", F.lit("")) != "", F.split("aliases", ",")).otherwise(F.array().cast("array<string>")).alias("aliases"))


def flattened_edges(edges: DataFrame) -> DataFrame:
    """Relationships as they are stored: flat prop_ and temporal_ text properties beside the ends and the type."""
    none = F.create_map().cast("map<string,string>")
    bag = lambda c, prefix: F.transform_keys(F.coalesce(c, none), lambda k, _: F.concat(F.lit(prefix), k)) if c in edges.columns else none
    have = lambda c: F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c)
    return edges.select("id", "source_id", "target_id", "type", "confidence", have("evidence"), have("reasoning"), "document_id", have("chunk_id"), F.map_concat(bag("properties", "prop_"), bag("temporal_info", "temporal_")).alias("properties"))


def read_edges(stored: DataFrame) -> DataFrame:
    """Stored relationships as records again; an unknown type is a reference."""
    part = lambda prefix: F.transform_keys(F.map_filter("properties", lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1_000_000))
    temporal = part("temporal_")
    kind = F.when(F.col("type").isin(vocab.RELATIONSHIP_TYPES), F.col("type")).otherwise("REFERENCES")
    return stored.select("id", "source_id", "target_id", kind.alias("type"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), "evidence", "reasoning", "document_id", "chunk_id", part("prop_").alias("properties"), F.when(F.size(temporal) > 0, temporal).alias("temporal_info"))


def store_entities(entities: DataFrame, path: str, mode: str = "append") -> int:
    """Writes flattened entities; the number of rows written."""
    return counted(flattened_entities(entities), path, mode)


def store_edges(edges: DataFrame, nodes: DataFrame | None, path: str, mode: str = "append") -> tuple[int, int]:
    """(written, rejected) relationships; those without both ends in nodes are rejected."""
    if nodes is None:
        return counted(flattened_edges(edges), path, mode), 0
    good, rejected = insert_edges(nodes, edges.limit(0), edges)
    return counted(flattened_edges(good), path, mode), rejected.count()


def counted(df: DataFrame, path: str, mode: str) -> int:
    """Stores df and gives the number of its rows, counted while they are written."""
    seen = Observation()
    store(df.observe(seen, F.count(F.lit(1)).alias("n")), path, mode)
    return int(seen.get["n"])


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """Everything goes: an empty table of the schema is left."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def initialise(spark: SparkSession, folder: str) -> dict[str, str]:
    """Empty tables of nodes, edges, documents and chunks where there is none yet: their paths by name."""
    out = {}
    for name, schema in (("nodes", vocab.NODES), ("edges", vocab.EDGES), ("documents", vocab.DOCUMENTS), ("chunks", vocab.CHUNKS)):
        out[name] = f"{folder}/{name}"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(out[name])
    return out


def constraints(spark: SparkSession) -> DataFrame:
    """(label, property, kind) of what a store keeps: unique ids, secondary indexes, full-text indexes."""
    rows = [(n, "id", "unique") for n in vocab.NODE_PROPERTIES] + [(n, p, "index") for n in vocab.NODE_PROPERTIES for p in vocab.indexed_of(n)]
    rows += [(n, p, "fulltext") for n, ps in vocab.FULL_TEXT.items() for p in ps]
    return spark.createDataFrame(rows, "label string, property string, kind string")


def store_indexed(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Stored by document and sorted by the indexed columns inside, so that file statistics prune what a search reads."""
    df.repartition("document_id").sortWithinPartitions("document_id", *by).write.mode(mode).partitionBy("document_id").parquet(path)


def duplicate_ids(df: DataFrame) -> DataFrame:
    """The uniqueness that a store would enforce, as a query."""
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def text_index(nodes: DataFrame) -> DataFrame:
    """(word, id): postings of the words of nodes' texts."""
    return nodes.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != ""))).alias("word"), "id")
