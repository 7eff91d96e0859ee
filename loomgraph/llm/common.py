"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import connected_components  # noqa: F401
from ..lineage import cut, ensure_checkpoint_dir  # noqa: F401

#: Characters of text that an Arrow worker handles at once; bounds its memory whatever the rows hold.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids up to which a list of documents to drop is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """docs without the rows whose key is in bad: broadcast behind a check of their number, else a shuffled anti join."""
    bad = cut(bad)
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, on, "left_anti")


def text_chunks(batches: Iterator, columns: tuple[str, ...] = ("doc_id", "text"), most: int = CHUNK_CHARS) -> Iterator[list[list]]:
    """Lists of column values, a bounded number of characters at a time (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        at = np.concatenate([[0], np.cumsum(sizes + 16)])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
            part = batch.slice(first, last - first)
            yield [part.column(c).to_pylist() for c in columns]
            first = last
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of the links (u, v): (smallest member, other member), never more rows than members."""
    if not len(u):
        return u[:0], v[:0]
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]
