"""Extraction: a plug-in boundary. Rules work offline; a replay reads recorded answers; a live model is a function of a prompt."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from .resolve import resolve_edges
from .rules import known_types

ENTITY_JSON = "struct<entities:array<struct<text:string,type:string,context:string,confidence:double,attributes:map<string,string>>>>"
EDGE_JSON = "struct<relationships:array<struct<source_entity_id:string,target_entity_id:string,relationship_type:string,evidence:string,reasoning:string,confidence:double,properties:map<string,string>,source_entity_text:string,target_entity_text:string>>>"

#: Live models by provider: a function of (prompt, options) that gives the reply's text. It runs where the chunks are.
Model = Callable[[str, dict], str]
PROVIDERS: dict[str, Model] = {}
#: Parts of model names that tell their provider.
MODEL_NAMES = {"gpt": "openai", "claude": "anthropic"}
DEFAULT_PROVIDER = "openai"
#: Attempts of a call, and seconds waited before the second one (doubled each time, up to the last).
ATTEMPTS, WAIT, LONGEST = 3, 2.0, 10.0


def register(name: str, answer: Model) -> None:
    """Make a live model known by its provider's name."""
    PROVIDERS[name] = answer


def provider_of(model: str | None = None, provider: str | None = None) -> str:
    """The provider's name: given, or told by the model's, or the default where neither is given."""
    if provider is None:
        provider = DEFAULT_PROVIDER if model is None else next((p for part, p in MODEL_NAMES.items() if part in model.lower()), None)
    if provider is None or provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider}")
    return provider


def client(model: str | None = None, provider: str | None = None) -> Model:
    """The live model that answers, with the model's name among its options."""
    call = PROVIDERS[provider_of(model, provider)]
    return lambda prompt, options: call(prompt, ({"model": model} if model else {}) | options)


def called(call: Model, prompt: str, options: dict, attempts: int = ATTEMPTS, wait: float = WAIT) -> str:
    """The reply, tried again after a growing pause if the call fails."""
    for k in range(attempts):
        try:
            return call(prompt, options)
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(min(LONGEST, wait * 2**k))
    raise AssertionError


def responses(chunks: DataFrame, prompt: Column, call: Model, options: dict | None = None, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """chunks with response and fault: a live model's reply to each row's prompt; a call that fails at last is a fault, not a
    failed job. Batches of rows go to the workers, each with its own calls."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, faults = [], []
            for p in b.pop("_prompt"):
                try:
                    replies.append(called(call, p, options or {}, attempts, wait))
                    faults.append(None)
                except Exception as e:
                    replies.append(None)
                    faults.append(f"{type(e).__name__}: {e}")
            yield b.assign(response=replies, fault=faults)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", response string, fault string"
    return chunks.withColumn("_prompt", prompt).mapInPandas(run, out)


THINKING = "Think step by step in a <thinking> section, then give the final answer in a <response> section.\n\n"


def thought_prompt(prompt: Column) -> Column:
    return F.concat(F.lit(THINKING), prompt)


def thinking_of(c: Column | str) -> Column:
    """What stands between the thinking marks, empty if there are none."""
    return F.trim(F.regexp_extract(c, r"(?s)<thinking>(.*?)</thinking>", 1))


def response_of(c: Column | str) -> Column:
    """What stands between the response marks, the whole reply if there are none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"(?s)<response>.*?</response>"), F.regexp_replace(F.regexp_extract(c, r"(?s)<response>(.*?)</response>", 1), r"^\s+|\s+$", "")).otherwise(c)


def template(path: str | Path) -> str:
    """A prompt template: the whole file, empty if there is none."""
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.exists() else ""


def examples(spark: SparkSession, path: str) -> list[dict]:
    """The few-shot examples of a JSON file, none if there is no such file."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # a prompt's examples: one small file
    except Exception:
        return []
    return [x for r in rows for x in json.loads(r[0]).get("examples", [])]


def example_text(shown: list[dict], most: int = 2) -> str:
    out = []
    for k, x in enumerate(shown[:most], 1):
        out += [f"Example {k}", f"Input: {json.dumps(x['input'], ensure_ascii=False) if not isinstance(x['input'], str) else x['input']}", f"Output: {json.dumps(x['output'], ensure_ascii=False)}", ""]
    return "\n".join(out)


def prompt(text: str, chunk: Column | str, examples: list[str] = (), document_type: str | None = None, by_type: dict[str, str] | None = None) -> Column:
    """The entity prompt: {chunk_text} in the template gives way to the chunk; other braces stay as they are."""
    more = [by_type[document_type]] if by_type and document_type in by_type else []
    return F.concat_ws("\n", F.replace(F.lit(text), F.lit("{chunk_text}"), F.col(chunk) if isinstance(chunk, str) else chunk), *map(F.lit, [*more, *examples]))


def edge_prompt(text: str, chunk: Column | str, entities: Column, guide: str = "", examples: list[str] = ()) -> Column:
    """The relationship prompt: as prompt, and {entities_json} gives way to the chunk's entities (an array of structs)."""
    base = F.replace(F.replace(F.lit(text), F.lit("{entities_json}"), F.to_json(entities)), F.lit("{chunk_text}"), F.col(chunk) if isinstance(chunk, str) else chunk)
    return F.concat_ws("\n", base, *map(F.lit, [*([guide] if guide else []), *examples]))


def with_entities(chunks: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """Chunks that have at least so many entities, with these as an array of (id, text, type, confidence) in order."""
    own = entities.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text", "type", "confidence"))).alias("e")).where(F.size("e") >= least)
    shown = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["type"].alias("type"), x["confidence"].alias("confidence")))
    return chunks.join(own, chunks["id"] == own["chunk_id"]).select(*(chunks[c] for c in chunks.columns), shown.alias("entities"))


def chunk_windows(entities: DataFrame, documents: DataFrame, width: int = 500) -> DataFrame:
    """(id, document_id, text): for each chunk of entities with places (start, end) the part of its document around them, and
    their contexts joined where none has a place. documents: id, content."""
    near = entities.groupBy("chunk_id", "document_id").agg(F.min(F.when(F.col("end").isNotNull(), F.col("start"))).alias("low"), F.max(F.when(F.col("start").isNotNull(), F.col("end"))).alias("high"), F.array_sort(F.collect_list(F.when(F.coalesce("context", F.lit("")) != "", F.struct("ordinal", "context")))).alias("told"))
    out = near.join(documents.select(F.col("id").alias("document_id"), "content"), "document_id", "left")
    start = F.greatest(F.lit(0), F.col("low") - width)
    end = F.least(F.char_length("content"), F.col("high") + width)
    text = F.when(F.col("low").isNull(), F.array_join(F.transform("told", lambda x: x["context"]), " ")).otherwise(F.substring("content", start + 1, end - start))
    return out.select(F.col("chunk_id").alias("id"), "document_id", text.alias("text"))


def edges_from_entities(entities: DataFrame, documents: DataFrame, call: Model, template_text: str, least: int = 2) -> DataFrame:
    """Relationships among all entities of documents, by a live model over a window of text around each chunk's entities."""
    windows = with_entities(chunk_windows(entities, documents), entities, least)
    told = responses(windows, edge_prompt(template_text, "text", F.col("entities")), call)
    return replay_edges(told.where("fault is null"), entities)


def batch_extract(chunks: DataFrame, call: Model, template_text: str, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(entities, rejects) of all chunks of any level by a live model; a task has about size chunks, so that calls spread out."""
    tasks = max(1, min(chunks.count() // max(1, size), 100_000))
    told = responses(chunks.repartition(tasks, "id"), prompt(template_text, "text"), call)
    return replay_entities(told.where("fault is null")), told.where("fault is not null").select("id", "fault")


def unfenced(c: Column | str) -> Column:
    """The JSON of an answer: all of it, or what stands in a fence."""
    c = F.col(c) if isinstance(c, str) else c
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(inner != "", inner).otherwise(c)


def answers(c: Column | str, schema: str, field: str) -> Column:
    item = schema[schema.index(":") + 1 : -1]
    j = unfenced(response_of(c))
    # a bare list becomes the field of an object, so that one schema reads both
    whole = F.when(F.ltrim(j).startswith("["), F.concat(F.lit(f'{{"{field}": '), j, F.lit("}"))).otherwise(j)
    return F.coalesce(F.from_json(whole, schema)[field], F.array().cast(item))


def replay_entities(chunks: DataFrame, response: str = "response") -> DataFrame:
    """Entities of recorded answers; a missing confidence is 0.5, one out of range drops the row, unknown types are concepts."""
    section = F.col("section_title") if "section_title" in chunks.columns else F.lit(None).cast("string")
    own = F.col("text") if "text" in chunks.columns else F.lit(None).cast("string")
    first = F.col("start") if "start" in chunks.columns else F.lit(0)
    rows = chunks.select("id", "document_id", section.alias("section"), own.alias("_chunk"), first.alias("_first"), F.posexplode(answers(response, ENTITY_JSON, "entities")).alias("ordinal", "e"))
    found = F.position(F.col("e.text"), F.col("_chunk"))
    start = F.when(found > 0, F.col("_first") + found - 1).cast("int")
    df = rows.select(F.concat_ws("_", F.lit("ent"), "document_id", T.entity_id("document_id", "e.type", "e.text", "id", F.col("ordinal").cast("string"))).alias("id"), "e.text", "e.type", F.coalesce("e.confidence", F.lit(0.5)).alias("confidence"), "e.context", "document_id", F.col("id").alias("chunk_id"), "e.attributes", F.col("ordinal").cast("long").alias("ordinal"), "section", start.alias("start"), (start + F.char_length("e.text")).cast("int").alias("end"))
    return known_types(df.where("confidence between 0 and 1 and text is not null"), "type", vocab.ENTITY_TYPES, "Legal_Concept")


def replay_edges(chunks: DataFrame, entities: DataFrame, response: str = "response", aliases: DataFrame | None = None) -> DataFrame:
    """Relationships of recorded answers whose both ends are entities of the chunk. With aliases, ends without an id are found by
    their texts first."""
    rows = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.explode(answers(response, EDGE_JSON, "relationships")).alias("r"))
    df = rows.select("chunk_id", "document_id", F.col("r.source_entity_id").alias("source_id"), F.col("r.target_entity_id").alias("target_id"), F.col("r.relationship_type").alias("type"), F.coalesce("r.confidence", F.lit(0.5)).alias("confidence"), "r.evidence", "r.reasoning", "r.properties", F.col("r.source_entity_text").alias("source_text"), F.col("r.target_entity_text").alias("target_text"))
    if aliases is not None:  # ends that the answer names by text only
        df = resolve_edges(df, entities, aliases)
    own = lambda c: entities.select("chunk_id", F.col("id").alias(c))
    df = df.join(own("source_id"), ["chunk_id", "source_id"], "left_semi").join(own("target_id"), ["chunk_id", "target_id"], "left_semi")
    df = df.withColumn("id", F.concat_ws("_", F.lit("rel"), "source_id", "target_id", "type", T.entity_id("document_id", "chunk_id", "source_id", "target_id", "type")))
    return known_types(df.drop("source_text", "target_text"), "type", vocab.RELATIONSHIP_TYPES, "REFERENCES").where("confidence between 0 and 1")


def rule_entities(chunks: DataFrame) -> DataFrame:
    """Entities by expressions: parties, dates, amounts, clause references, each with its place in the chunk."""
    kinds = ["Legal_Party", "Temporal_Entity", "Financial_Term", "Clause_Reference"]

    def of_kind(pattern: str, kind: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type")))

    found = F.concat(*(of_kind(p, k) for p, k in zip(T.MENTIONS, kinds, strict=True)))
    rows = chunks.select("id", "document_id", F.col("text").alias("_chunk"), F.posexplode(found).alias("ordinal", "e"))
    place = F.position(F.col("e.text"), F.col("_chunk")) - 1
    return rows.select(F.concat_ws("_", F.lit("ent"), "document_id", T.entity_id("document_id", "e.type", "e.text", "id")).alias("id"), "e.text", "e.type", F.lit(0.75).alias("confidence"), "document_id", F.col("id").alias("chunk_id"), place.alias("start"), F.col("ordinal").cast("long").alias("ordinal"))
