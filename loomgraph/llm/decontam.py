"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity with it. So items are partitioned by size, and for
each size class u (a power of two) every document is covered by windows of 2u shingles, u apart: whatever holds an
item of that class lies in one window, with which the similarity is high. Windows' MinHash signatures come from
those of blocks of the smallest class by pairwise minima. A window that agrees with an item in any of the signature's
values is a candidate (bands of one row: the recall that containment needs), and a candidate is verified by exact
containment of the item's distinct shingles in the document's.

With 48 values, an item of containment 0.8 is missed by its window with a chance under 2.3e-5 in the worst case, and 1e-6 for
exact passages. Items of up to four shingles, which must be there whole and are too short for a signature, are looked up by a
shingle's hash. Items are the stated query set: they are taken in blocks of a bounded size, each against all documents.

Null or empty texts (of items or documents) match nothing. A text shorter than a shingle is one shingle. Repeated rows
match as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_chunks, without
from .simhash import shingle_hashes

WORDS, THRESHOLD = 5, 0.8
VALUES = 48
SMALLEST = 8
#: Shingles of an item up to which it is looked up by hash; at 0.8 all of them must be there.
TINY = 4
#: Items, and characters of items, that go to the executors at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 64_000_000


def multipliers(n: int = VALUES) -> np.ndarray:
    """Odd multipliers: each orders the (already mixed) shingle hashes in its own way."""
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Index:
    """Signatures of a block of items by size class."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.a = multipliers()
        self.items = [(i, np.unique(np.array(h, np.uint64))) for i, h in items if h]
        classes: dict[int, list[int]] = {}
        tiny = [k for k, (_, h) in enumerate(self.items) if len(h) <= TINY]
        first = np.array([self.items[k][1][0] for k in tiny], np.uint64)
        order = np.argsort(first, kind="stable")
        self.tiny, self.tiny_items = first[order], np.array(tiny, np.int64)[order]
        for k, (_, h) in enumerate(self.items):
            if len(h) <= TINY:
                continue
            u = max(SMALLEST, 1 << (len(h) - 1).bit_length())
            classes.setdefault(u, []).append(k)
        self.by_class = []
        for u, members in sorted(classes.items()):
            signature = np.array([(self.items[k][1][:, None] * self.a).min(0) for k in members])
            tables = []
            for v in range(VALUES):
                order = np.argsort(signature[:, v], kind="stable")
                sorted_values = signature[order, v]
                seen = np.zeros(1 << 16, bool)
                seen[(sorted_values >> np.uint64(48)).astype(np.int64)] = True
                tables.append((sorted_values, np.array(members)[order], seen))
            self.by_class.append((u, tables))

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) for texts whose shingles begin at starts; every text has one at least."""
        sizes = np.diff(np.append(starts, len(hashes)))
        blocks = -(-sizes // SMALLEST)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
        at = np.repeat(starts, blocks) + inner * SMALLEST
        found: set[tuple[int, int]] = set()
        if len(self.tiny):
            hit = np.flatnonzero(self.tiny[np.minimum(np.searchsorted(self.tiny, hashes), len(self.tiny) - 1)] == hashes)
            text = np.searchsorted(starts, hit, side="right") - 1
            for t, x in zip(text.tolist(), hashes[hit], strict=True):
                lo, hi = np.searchsorted(self.tiny, x, "left"), np.searchsorted(self.tiny, x, "right")
                found.update((t, int(k)) for k in self.tiny_items[lo:hi])
        for v in range(VALUES if self.by_class else 0):
            low = np.minimum.reduceat(hashes * self.a[v], at)
            f, n, u = first, blocks, SMALLEST
            for want, tables in self.by_class:
                while u < want:  # halve the number of blocks
                    half = -(-n // 2)
                    g = np.concatenate([[0], np.cumsum(half)[:-1]])
                    low = np.minimum.reduceat(low, np.repeat(f, half) + 2 * (np.arange(half.sum()) - np.repeat(g, half)))
                    f, n, u = g, half, u * 2
                # a window is two neighbouring blocks of a text, so its minimum is one of theirs: probing blocks probes windows
                values, items, seen = tables[v]
                hit = np.flatnonzero(seen[(low >> np.uint64(48)).astype(np.int64)])
                if not len(hit):
                    continue
                text = np.searchsorted(f, hit, side="right") - 1
                right = np.where(hit + 1 < f[text] + n[text], hit + 1, hit)
                left = np.where(hit > f[text], hit - 1, hit)
                small = (low[hit] <= low[right]) | (low[hit] <= low[left])  # the least of some window that it is in
                for t, x in zip(text[small].tolist(), low[hit][small], strict=True):
                    lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                    found.update((t, int(k)) for k in items[lo:hi])
        return found


def matches(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of documents that hold an item; keep: columns of type long that go with it."""
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    blocks = max(1, -(-sizes["n"] // block_items), -(-(sizes["chars"] or 0) // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        held = [(r["item_id"], shingle_hashes(r["text"], words)) for r in part.select("item_id", "text").collect()]
        found = search(docs, held, words, threshold, keep)
        out = found if out is None else out.unionAll(found)
    return out


def search(docs: DataFrame, held: list[tuple[int, list[int]]], words: int, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held)
        for ids, texts, *more in text_chunks(batches, ("doc_id", "text", *keep)):
            hashes = [shingle_hashes(t, words) for t in texts]
            full = [k for k, h in enumerate(hashes) if h]
            if not full or not index.items:
                continue
            sizes = np.array([len(hashes[k]) for k in full])
            flat = np.fromiter((x for k in full for x in hashes[k]), np.uint64, int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = []
            own: dict[int, np.ndarray] = {}
            for t, i in sorted(index.candidates(flat, starts)):
                item, h = index.items[i]
                if t not in own:
                    own = {t: np.unique(flat[starts[t] : starts[t] + sizes[t]])}
                shared = int(np.isin(h, own[t], assume_unique=True).sum())
                if shared >= threshold * len(h) - 1e-9:
                    rows.append((ids[full[t]], item, shared, len(h), shared / len(h), *(m[full[t]] for m in more)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.float64(),) + (pa.int64(),) * len(keep), strict=True)], names=["doc_id", "item_id", "shared", "item_shingles", "containment", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(run, "doc_id long, item_id long, shared long, item_shingles long, containment double" + "".join(f", {c} long" for c in keep))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; rows without doc_id are kept. Rows of one doc_id are judged each by its own text."""
    version = fresh(docs, "version")
    docs = docs.withColumn(version, F.xxhash64("text"))
    bad = matches(docs, items, keep=(version,)).where("doc_id is not null").select("doc_id", version).distinct()
    return without(docs, bad, ["doc_id", version]).drop(version).select(*docs.drop(version).columns)


def oracle(words: int = WORDS, threshold: float = THRESHOLD) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def shingles(name: str, key: str) -> str:
        return f"""{name}_w AS (SELECT {key}, row_number() OVER () AS r, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {name} WHERE text IS NOT NULL),
{name}_s AS (SELECT {key}, r, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {words - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {words - 1}], ' ')))) AS s FROM {name}_w WHERE len(w) > 0)"""

    return f"""
WITH {shingles("documents", "doc_id")}, {shingles("benchmark", "item_id")},
sizes AS (SELECT r, count(*) AS n FROM benchmark_s GROUP BY r),
hits AS (SELECT d.doc_id, d.r AS dr, b.item_id, b.r AS br, count(*) AS shared FROM documents_s d JOIN benchmark_s b ON d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment FROM hits JOIN sizes ON br = sizes.r WHERE shared >= {threshold} * n - 1e-9"""
