"""Deduplication, cross-document clusters, coreference and similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..components import connected_components
from ..lineage import cut, spread

# fixed values
PRONOUNS = [
    "it", "its", "itself",
    "he", "his", "him", "himself",
    "she", "her", "hers", "herself",
    "they", "their", "theirs", "them", "themselves",
    "we", "our", "ours", "us", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
]
# fixed values: definitions of a party's role, in order
DEFINITIONS = [
    r"""([^,\(]+)\s*\((?:the\s+)?['"]([^'"]+)['"]\)""",
    r"""([^,\(]+)\s*\(hereinafter\s+['"]([^'"]+)['"]\)""",
    r"""([^,\(]+)\s*,\s*(?:a|an)\s+[^,]+\s+\(['"]([^'"]+)['"]\)""",
]
SUFFIX = r" (inc|llc|corp|corporation|ltd|limited|company|co)$"


def dedupe_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def alias_key(c: Column | str) -> Column:
    """White space collapsed, lower case, without marks at the end; null is empty."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"[.,;:]+$", ""), F.lit(""))


def cluster_key(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def dedupe_exact(entities: DataFrame, order: str = "id", keep_aliases: bool = True) -> DataFrame:
    """One entity for each (type, normalised text): the best confidence, the earliest on ties; losers' texts are aliases."""
    key = dedupe_key("text")
    best = Window.partitionBy("type", key).orderBy(F.desc("confidence"), order)
    ranked = entities.withColumn("_r", F.row_number().over(best)).withColumn("_k", key)
    won = ranked.where("_r = 1").drop("_r")
    if not keep_aliases:
        return won.drop("_k")
    lost = ranked.where("_r > 1").groupBy("type", "_k").agg(F.array_sort(F.collect_set("text")).alias("found_aliases"), F.count("*").alias("merged"))
    return won.join(lost, ["type", "_k"], "left").withColumns({"found_aliases": F.coalesce("found_aliases", F.array().cast("array<string>")), "merged": F.coalesce("merged", F.lit(0)).cast("long")}).drop("_k")


def exact_clusters(entities: DataFrame, order: str = "id") -> DataFrame:
    """(canonical_id, id, size) of texts that several entities of a type share."""
    keyed = entities.withColumn("_k", cluster_key("text"))
    sizes = keyed.groupBy("type", "_k").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("confidence")).alias("c"), F.col(order).alias("o"), F.col("id"))).alias("best")).where("size > 1")
    return keyed.join(sizes.select("type", "_k", "size", F.col("best.id").alias("canonical_id")), ["type", "_k"]).select("canonical_id", "id", "size")


def cluster_statistics(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("canonical_id").agg(F.count("*").alias("k"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("k"), F.lit(0)).alias("mentions"), F.round(F.coalesce(F.avg("k"), F.lit(0.0)), 2).alias("avg_size"), F.coalesce(F.max("k"), F.lit(0)).alias("max_size"))


# ---- similarity -----------------------------------------------------------------------------------------------------

#: Rows of a block that one task compares with those of another.
BLOCK_ROWS = 4_096


def norm_of(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(vector, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v * v))


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a direction, and their unit vectors; null and zero vectors have none."""
    norm = norm_of(vector)
    return df.where(norm > 0).withColumn("unit", F.transform(vector, lambda v: v.cast("double") / norm))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def similar_pairs(df: DataFrame, threshold: float, key: str = "vec_id", block: str = "label", places: int | None = 4) -> DataFrame:
    """(left, right, cosine), left < right, of the rows of a block at least so similar.

    A block is dealt out as pairs of parts of a bounded size, each pair one matrix product: a large block is many tasks, and
    only pairs that are similar leave Python.
    """
    u = normalised(df).select(F.col(key).alias("_id"), F.col(block).alias("_block"), "unit")
    sizes = u.groupBy(F.col("_block").alias("_of")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("parts"))
    own = F.pmod(F.xxhash64("_id"), F.col("parts"))
    dealt = u.join(sizes, F.col("_block").eqNullSafe(F.col("_of"))).select("_id", "_block", "unit", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("_id", "_block", "unit", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind = dict(df.dtypes)[key]

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        ids, x, own = part["_id"].to_numpy(), np.array(part["unit"].tolist()), part["own"].to_numpy()
        lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        out = []
        for f in range(0, len(a), 512):
            near = x[a[f : f + 512]] @ x[b].T
            i, j = np.nonzero(near >= threshold - 1e-12)
            cosine, i, j = near[i, j], ids[a[f + i]], ids[b[j]]
            ok = i < j if lo == hi else i != j
            out.append(pd.DataFrame({"left": np.minimum(i[ok], j[ok]), "right": np.maximum(i[ok], j[ok]), "cosine": cosine[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"left": ids[:0], "right": ids[:0], "cosine": np.zeros(0)})

    pairs = dealt.groupBy("_block", "lo", "hi").applyInPandas(compare, f"left {kind}, right {kind}, cosine double")
    return pairs if places is None else pairs.withColumn("cosine", F.round("cosine", places))


def nearest(df: DataFrame, query: list[float], k: int = 5, threshold: float = -1.0, key: str = "vec_id") -> DataFrame:
    """The k rows most similar to a query vector, those below the threshold left out afterwards."""
    q = np.asarray(query, float)
    q = q / np.sqrt((q * q).sum())
    sim = dot("unit", F.array(*map(F.lit, q.tolist())))
    return normalised(df).select(key, sim.alias("cosine")).orderBy(F.desc("cosine"), key).limit(k).where(F.col("cosine") >= threshold).withColumn("cosine", F.round("cosine", 4))


def by_component(df: DataFrame, threshold: float, key: str, block: str, extra: list[str], run, schema: str) -> DataFrame:
    """run over the similar pairs of each connected component: what an order-dependent scan decides inside one doesn't depend
    on the rest. run gets columns a, b (a earlier) and extra of both as a_..., b_...."""
    pairs = cut(similar_pairs(df, threshold, key, block, None).select(F.col("left").alias("a"), F.col("right").alias("b")))
    labels = connected_components(pairs)
    tagged = pairs.join(labels, pairs["a"] == labels["node"], "left").select("a", "b", F.coalesce("component", "a").alias("component"))
    for side in "ab" if extra else "":
        tagged = tagged.join(df.select(F.col(key).alias(side), *(F.col(c).alias(f"{side}_{c}") for c in extra)), side)
    return tagged.groupBy("component").applyInPandas(run, schema)


def greedy(df: DataFrame, threshold: float, key: str = "vec_id", score: str = "confidence", block: str = "label") -> DataFrame:
    """(key, block) of the rows that an order-dependent dedupe of each block keeps: a later similar row goes unless it scores
    higher, then the earlier one goes. Rows without a direction and rows like no other stay. key is unique, and its order
    is that of the rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        scores = dict(zip(part["a"], part[f"a_{score}"], strict=True)) | dict(zip(part["b"], part[f"b_{score}"], strict=True))
        later: dict = {}
        for a, b in sorted(zip(part["a"], part["b"], strict=True)):
            later.setdefault(a, []).append(b)
        gone = set()
        for a, others in sorted(later.items()):
            for b in others:
                if a in gone:
                    break
                if b not in gone:
                    gone.add(a if scores[b] > scores[a] else b)
        return pd.DataFrame({"gone": sorted(gone)})

    gone = by_component(df, threshold, key, block, [score], run, f"gone {dict(df.dtypes)[key]}")
    return df.select(key, block).join(gone, F.col(key) == F.col("gone"), "left_anti")


def leaders(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", block: str = "label") -> DataFrame:
    """(canonical, member): each unclustered row takes all later ones that are similar to it; lone rows are left out."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        later: dict = {}
        for a, b in sorted(zip(part["a"], part["b"], strict=True)):
            later.setdefault(a, []).append(b)
        taken, rows = set(), []
        for a, others in sorted(later.items()):
            own = [] if a in taken else [b for b in others if b not in taken]
            if own:
                taken |= {a, *own}
                rows += [(a, m) for m in (a, *own)]
        return pd.DataFrame(rows, columns=["canonical", "member"])

    kind = dict(df.dtypes)[key]
    return by_component(df, threshold, key, block, [], run, f"canonical {kind}, member {kind}")


def dedupe(entities: DataFrame, threshold: float = 0.85, order: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """Both stages within each type: exact texts, then similar vectors among what is left. An entity alone in its type stays."""
    exact = cut(dedupe_exact(entities, order))
    keyed = exact.select(F.col(order).alias("_o"), F.col("type").alias("_t"), "confidence", F.col(vector).alias("embedding"))
    return exact.join(greedy(keyed, threshold, "_o", "confidence", "_t"), exact[order] == F.col("_o"), "left_semi")


def disambiguate(entities: DataFrame, threshold: float = 0.9, group_by_type: bool = True, include_singletons: bool = False, order: str = "ordinal") -> DataFrame:
    """(canonical_id, id): clusters of equal texts, then of similar vectors among the rest.

    An entity alone in its group is a cluster; others that are like none are left out unless include_singletons.
    entities: id, text, type, confidence, ordinal, embedding.
    """
    e = entities if group_by_type else entities.withColumn("type", F.lit("any"))
    exact = cut(exact_clusters(e, order).select("canonical_id", "id"))
    rest = e.join(exact, "id", "left_anti")
    by_place = leaders(rest.select(F.col(order).alias("_o"), F.col("type").alias("_t"), "embedding"), threshold, "_o", "_t")
    name = lambda c: rest.select(F.col(order).alias(c), F.col("id").alias(f"{c}_id"))
    close = by_place.join(name("canonical"), "canonical").join(name("member"), "member").select(F.col("canonical_id"), F.col("member_id").alias("id"))
    out = exact.unionByName(close)
    left = e.join(out, "id", "left_anti")
    if not include_singletons:
        left = left.join(e.groupBy("type").count().where("count = 1"), "type", "left_semi")
    return out.unionByName(left.select(F.col("id").alias("canonical_id"), "id"))


def canonical_lookup(ids: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, canonical_id): that of membership (canonical_id, id), else the id itself."""
    return ids.select("id").join(membership.select("id", "canonical_id"), "id", "left").select("id", F.coalesce("canonical_id", "id").alias("canonical_id"))


def merge_clusters(membership: DataFrame, first: str, second: str) -> tuple[DataFrame, str]:
    """(membership, surviving id): the larger cluster's id names both, the first on ties; an unknown id changes nothing."""
    sizes = {r["canonical_id"]: r["n"] for r in membership.where(F.col("canonical_id").isin(first, second)).groupBy("canonical_id").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return membership, first
    kept, gone = (first, second) if sizes[first] >= sizes[second] else (second, first)
    return membership.withColumn("canonical_id", F.when(F.col("canonical_id") == gone, kept).otherwise(F.col("canonical_id"))), kept


def merged_two(a: Column, b: Column) -> Column:
    """Two entities (structs with id, text, confidence, aliases, attributes) as one: the more confident one (a on ties) with the
    other's text as an alias, the other's attributes where it has none, and the mean confidence."""

    def one(x: Column, y: Column) -> Column:
        none = F.array().cast("array<string>")
        aliases = F.coalesce(x["aliases"], none)
        aliases = F.when(F.array_contains(aliases, y["text"]), aliases).otherwise(F.concat(aliases, F.array(y["text"])))
        own = F.coalesce(x["attributes"], F.create_map().cast("map<string,string>"))
        more = F.map_filter(F.coalesce(y["attributes"], F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(own), k))
        return F.struct(x["id"].alias("id"), x["text"].alias("text"), ((x["confidence"] + y["confidence"]) / 2).alias("confidence"), aliases.alias("aliases"), F.map_concat(own, more).alias("attributes"))

    return F.when(a["confidence"] >= b["confidence"], one(a, b)).otherwise(one(b, a))


@F.pandas_udf(DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts in lower case."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# ---- coreference ----------------------------------------------------------------------------------------------------


def defined_aliases(entities: DataFrame) -> DataFrame:
    """(alias, canonical_id, rank, ordinal): names and roles that a party's context (its text if it has none) defines, rank 0,
    and aliases that came with the party, rank 1. A match is looked for once, where the marks that it needs are there; the groups
    are read from it alone, as the expressions look at nothing around it."""
    parties = spread(entities.where("type = 'Legal_Party'"), "id")
    near = F.when(F.coalesce("context", F.lit("")) != "", F.col("context")).otherwise(F.col("text")) if "context" in entities.columns else F.col("text")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    read = lambda p: lambda x: F.struct(F.regexp_extract(x, p, 1).alias("name"), F.regexp_extract(x, p, 2).alias("role"))
    holds = lambda p: F.contains(near, F.lit("(")) & (F.contains(near, F.lit(",")) if r"\s*,\s*" in p else F.lit(True))
    whole = lambda p: F.when(holds(p), F.regexp_extract_all(near, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pairs = F.concat(*(F.transform(whole(p), read(p)) for p in DEFINITIONS))
    found = parties.select("id", "text", "ordinal", F.explode(pairs).alias("p")).select("id", "text", "ordinal", strip(F.col("p.name")).alias("name"), strip(F.col("p.role")).alias("role"))
    found = found.where(F.contains(alias_key("text"), alias_key("name")))
    told = found.select(F.explode(F.array("name", "role", F.concat(F.lit("the "), F.col("role")))).alias("alias"), F.col("id").alias("canonical_id"), F.lit(0).alias("rank"), F.col("ordinal").cast("long").alias("ordinal"))
    if "aliases" not in entities.columns:
        return told
    return told.unionByName(parties.select(F.explode("aliases").alias("alias"), F.col("id").alias("canonical_id"), F.lit(1).alias("rank"), F.col("ordinal").cast("long").alias("ordinal")))


def party_aliases(entities: DataFrame) -> DataFrame:
    """(alias, canonical_id): of those that define an alias the last one has it."""
    last = defined_aliases(entities).groupBy(alias_key("alias").alias("alias")).agg(F.max(F.struct("rank", "ordinal", "canonical_id")).alias("last"))
    return last.select("alias", F.col("last.canonical_id").alias("canonical_id"))


#: Length of the pieces by which names and mentions meet, and the number of buckets that these fall into.
PIECE, BUCKETS = 3, 65_536


def first_within(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(k, f): the texts of the keys' lengths that names (name, f) hold, each with the least f; among them is every key that a name
    holds.

    What the mentions' first pieces (all, of a shorter one) look like is kept as the lengths by bucket: a table of a bounded size.
    At each place of a name it says which lengths to cut out there; these texts meet by equality. So the work grows with the names'
    lengths, not with the number of names that share a piece.
    """
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    size = F.char_length("k")
    wanted = keys.where("k <> ''").groupBy(of(F.substring("k", 1, PIECE)).alias("bucket")).agg(F.collect_set(size).alias("sizes"))
    places = names.where("name <> ''").select("name", "f", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("at"))
    left = F.char_length("name") - F.col("at") + 1
    pieces = F.explode(F.sequence(F.lit(1), F.least(left, F.lit(PIECE)))).alias("n")
    met = places.select("name", "f", "at", pieces).withColumn("bucket", of(F.substring("name", F.col("at"), F.col("n")))).join(F.broadcast(wanted), "bucket")
    cut_out = met.select("name", "f", "at", "n", F.explode("sizes").alias("size")).where((F.least("size", F.lit(PIECE)) == F.col("n")) & (F.col("size") <= left))
    return cut_out.groupBy(F.substring("name", F.col("at"), F.col("size")).alias("k")).agg(F.min("f").alias("f"))


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, canonical_id): alias, else none for pronouns, else the first equal text, else the first party by partial name.

    A mention that is part of a name meets it by equality with the name's parts of its length; the empty mention is part of every
    name.
    """
    m = mentions.select("mention", alias_key("mention").alias("k")).distinct()
    least = lambda df, k: df.groupBy(k).agg(F.min(F.struct("ordinal", "id")).alias("f"))
    hit = lambda df, name: df.select("k", F.col("f.id").alias(name))
    same = hit(least(entities.withColumn("k", alias_key("text")), "k"), "same")
    names = least(entities.where("type = 'Legal_Party'").withColumn("name", alias_key("text")), "name")
    bare = names.select(F.regexp_replace("name", SUFFIX, "").alias("k"), "f")
    anyone = names.agg(F.min("f").alias("f")).where("f is not null").select(F.lit("").alias("k"), "f")
    found = first_within(m.select("k").distinct(), names).unionByName(bare).unionByName(anyone)
    part = hit(found.groupBy("k").agg(F.min("f").alias("f")), "part")
    out = m.join(aliases.withColumnRenamed("alias", "k"), "k", "left").join(same, "k", "left").join(part, "k", "left")
    return out.select("mention", F.when(F.col("canonical_id").isNotNull(), F.col("canonical_id")).when(F.col("k").isin(PRONOUNS), None).otherwise(F.coalesce("same", "part")).alias("canonical_id"))


def resolve_edges(edges: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """edges (source_id, source_text, target_id, target_text, ...) with missing ends found by their texts; those whose both
    ends are known by then. Ends that don't look for a text are dealt out evenly, not together under one empty key."""
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    asks = lambda side: told(f"{side}_text") & ~told(f"{side}_id")
    mentions = edges.where(asks("source")).select(F.col("source_text").alias("mention"))
    mentions = mentions.unionAll(edges.where(asks("target")).select("target_text")).distinct()
    known = resolve(mentions, entities, aliases).select(F.concat(F.lit("="), "mention").alias("_ask"), F.col("canonical_id").alias("_hit"))
    spread = F.pmod(F.xxhash64("source_id", "source_text", "target_id", "target_text"), F.lit(1_024)).cast("string")
    out = edges
    for side in ("source", "target"):
        key = F.when(asks(side), F.concat(F.lit("="), f"{side}_text")).otherwise(F.concat(F.lit("-"), spread))
        out = out.withColumn("_ask", key).join(known, "_ask", "left")
        out = out.withColumn(f"{side}_id", F.when(told(f"{side}_id"), F.col(f"{side}_id")).otherwise(F.col("_hit"))).drop("_hit", "_ask")
    return out.where(told("source_id") & told("target_id")).select(*edges.columns)


def canonical_ids(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, canonical_id): the id itself if it defines aliases, else the first one that has the id's text as a lower-case alias,
    else the id itself. aliases as of defined_aliases."""
    own = aliases.select(F.col("canonical_id").alias("id")).distinct().withColumn("own", F.lit(True))
    named = aliases.groupBy(F.lower("alias").alias("id")).agg(F.min(F.struct("rank", "ordinal", "canonical_id")).alias("f")).select("id", F.col("f.canonical_id").alias("by_name"))
    out = ids.select("id").distinct().join(own, "id", "left").join(named, "id", "left")
    return out.select("id", F.when(F.col("own"), F.col("id")).otherwise(F.coalesce("by_name", "id")).alias("canonical_id"))


def merge_group(entities: DataFrame, by: str) -> DataFrame:
    """One entity a group: the best one's columns, all other texts and aliases as aliases, the mean confidence."""
    more = [F.flatten(F.collect_list("aliases")).alias("more")] if "aliases" in entities.columns else [F.array().cast("array<string>").alias("more")]
    g = entities.groupBy(by).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "ordinal", "id", "text", "type")).alias("b"), F.collect_set("text").alias("texts"), F.avg("confidence").alias("confidence"), *more)
    aliases = F.array_sort(F.array_except(F.array_union("texts", "more"), F.array("b.text")))
    return g.select(by, F.col("b.id").alias("id"), F.col("b.text").alias("text"), F.col("b.type").alias("type"), aliases.alias("aliases"), "confidence")


def merge_coreferent(entities: DataFrame) -> DataFrame:
    """One entity for each canonical id of the entities' own definitions."""
    ids = canonical_ids(entities, defined_aliases(entities))
    return merge_group(entities.join(ids, "id"), "canonical_id")
