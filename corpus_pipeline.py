"""The corpus pipeline: language identification, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, langid, nearcopies, packing, pii
from loomgraph.llm.common import ensure_checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go; the others' lang is what their text says."""
    return langid.keep_identified(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return nearcopies.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", redact),
    ("packing", pack),
]

#: Trained models and dynamic programming aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; what lies between two of them is Parquet in the shared checkpoint folder.

    With a folder (shared by driver and executors) a run that broke off goes on after its last whole stage. Each stage's output is
    removed once the next one is written; the last one's stays for the result that reads it.
    """
    ensure_checkpoint_dir(spark)
    base = folder or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    paths = [f"{base}/{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    whole = [k for k, path in enumerate(paths) if hadoop(spark, f"{path}/_SUCCESS", "exists")]
    for k, (path, (_, stage)) in enumerate(zip(paths, STAGES, strict=False)):
        if not whole or k > whole[-1]:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if not whole or k >= whole[-1]:
            docs = spark.read.parquet(path)
            if before:
                hadoop(spark, before, "delete", True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def hadoop(spark: SparkSession, path: str, call: str, *args: object) -> bool:
    """A call of the file system of a path, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return getattr(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), call)(place, *args)
