"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints are computed where the text is read; equal ones are one row from then on. Correlated bits
are grouped into parts of unequal thresholds (dynamic programming over candidate counts estimated on a
bounded sample, which changes cost and never results): if two fingerprints differ in at most ``d`` bits
and the parts' (threshold + 1) sum to ``d + 1``, some part differs within its threshold. A part with
threshold t is probed by one key for each choice of t masked bits, so that both sides meet by equality.

Nulls and empty texts: fingerprint zero, linked like any other. Ties and repeated rows: equal fingerprints
are one class. A null doc_id keeps its row, with its class's component. Other columns are ignored. An empty table
gives an empty one. What goes on with the candidates for near copies by exact similarity is in ``nearcopies``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, forest, text_chunks

#: Fingerprints in a probe group beyond which it is dealt out as pairs of blocks.
GROUP_ROWS = 16_384
#: Fingerprints sampled to estimate candidate counts.
SAMPLE = 2_048
#: Cost of a comparison, in rows shuffled: a few nanoseconds against a microsecond or two.
COMPARED = 0.002
BITS = 64


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of the text, A-Z lowered, words split at ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [h(b" ".join(w), seed)]
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(line[s:e], seed) for s, e in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes as int64: a bit is 1 if it is set in over half of them."""
    out = np.zeros(len(hashes), np.int64)
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(size.sum()))
    starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
    counts = np.add.reduceat(np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.uint32)
    out[full] = np.packbits(counts * 2 > size[full, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), one row for each row of docs, fp over shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            fp = majority_bits([shingle_hashes(t, words) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0..63 dealt to parts of nearly equal width, each grown greedily around the most correlated bits."""
    x = bits - bits.mean(0)
    dev = np.sqrt((x * x).sum(0))
    c = np.abs(x.T @ x) / np.maximum(np.outer(dev, dev), 1e-9)
    c[:, dev == 0] = c[dev == 0] = 1  # constant bits tell nothing: they go together
    np.fill_diagonal(c, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        part = [max(left, key=lambda b: (c[b, left].max(), -b))]
        left.remove(part[0])
        while len(part) < width:
            nxt = max(left, key=lambda b: (c[b, part].sum(), -b))
            part.append(nxt)
            left.remove(nxt)
        out.append(sorted(part))
    return out


def allocate(sample: np.ndarray, rows: int, distance: int, most_masked: int = 2) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed, by dynamic programming on estimated costs.

    The cost of a part and threshold: rows shuffled (its probe keys) and pairs compared (those of the sample
    that agree so far, or as many as independent bits would give, carried to all rows). The parts' (threshold + 1) sum to
    distance + 1.
    """
    bits = ((sample[:, None].view(np.uint64) >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    scale = (rows / max(2, len(sample))) ** 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(max(1, -(-(distance + 1) // (most_masked + 1))), distance + 2):
        parts = correlated_parts(bits, m)
        cost = np.full((m, most_masked + 2), np.inf)
        for i, part in enumerate(parts):
            b = bits[:, part]
            apart = b.sum(1)[:, None] + b.sum(1)[None] - 2 * (b @ b.T)
            near = np.bincount(np.rint(apart[np.triu_indices(len(b), 1)]).astype(int), minlength=most_masked + 1)
            cost[i, 0] = 0.0  # threshold -1: the part isn't probed
            for t in range(most_masked + 1):
                if t < len(part):
                    keys = comb(len(part), t)
                    # a pair that differs in s of the part's bits meets under C(w - s, t - s) keys
                    pairs = sum(max(int(near[s]), len(b) ** 2 / 2 * comb(len(part), s) / 2.0 ** len(part)) * comb(len(part) - s, t - s) for s in range(t + 1))
                    cost[i, t + 1] = keys * rows + pairs * scale * COMPARED
        # table[i][k]: least cost by which parts 0..i-1 use k of distance + 1
        tablet = [[0.0] + [np.inf] * (distance + 1)]
        for i in range(m):
            tablet.append([min(tablet[i][k - t] + cost[i, t] for t in range(min(k, most_masked + 1) + 1)) for k in range(distance + 2)])
        total, k, chosen = tablet[m][distance + 1], distance + 1, []
        if not np.isfinite(total) or best is not None and total >= best[0]:
            continue
        for i in reversed(range(m)):
            t = min(range(min(k, most_masked + 1) + 1), key=lambda t, i=i, k=k: tablet[i][k - t] + cost[i, t])
            if t:
                chosen.append((parts[i], t - 1))
            k -= t
        best = (total, chosen)
    assert best is not None
    return best[1]


def probe_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The masks under which a pair within the distance agrees at least once, as signed 64-bit integers."""
    out = []
    for part, t in parts:
        for off in combinations(part, t):
            mask = sum(1 << b for b in part if b not in off)
            out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. As unsigned: of a negative number the bits of its absolute value would be counted."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


Strip = tuple[np.ndarray, np.ndarray, np.ndarray]


def near_strips(rows: np.ndarray, group: np.ndarray, distance: int) -> Iterator[Strip]:
    """(i, j, differing bits) of the near pairs of rows in each group, in bounded pieces.

    rows: mask, val, lo, hi, own, rep, fp, ...; group: run number of each row. All near pairs of a row i are in one piece;
    in a group that isn't dealt out i is the row of the larger rep, in a dealt one the row of block lo.
    """
    fp, rep = rows[6], rows[5]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    end = np.repeat(starts + sizes, sizes)
    at, step, found = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 48), sizes)), 1, []
    while len(at := at[at + step < end[at]]):
        d = differing(fp[at], fp[at + step])
        ok = d <= distance
        i, j = at[ok], at[ok] + step
        up = rep[i] > rep[j]
        found.append((np.where(up, i, j), np.where(up, j, i), d[ok]))
        step += 1
    if found:
        yield tuple(np.concatenate([f[k] for f in found]) for k in range(3))
    for k in np.flatnonzero(sizes > 48):
        lo, hi, own = rows[2:5, starts[k] : starts[k] + sizes[k]]
        whole = np.arange(starts[k], starts[k] + sizes[k])
        left, right = (whole, whole) if lo[0] == hi[0] else (whole[own == lo[0]], whole[own == hi[0]])
        block = max(1, 1_000_000 // max(1, len(right)))
        for f in range(0, len(left), block):
            part = left[f : f + block]
            d = differing(fp[part][:, None], fp[right][None])
            ok = d <= distance
            if lo[0] == hi[0]:
                ok &= rep[part][:, None] > rep[right][None]
            i, j = np.nonzero(ok)
            if len(i):
                yield part[i], right[j], d[i, j]


def star_forest(strips: Iterator[Strip], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs' components as (smallest rep, other rep)."""
    us, vs, held = [], [], 0
    for i, j, _ in strips:
        us.append(rows[5][i])
        vs.append(rows[5][j])
        held += len(i)
        if held > 1_000_000:
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [a], [b], len(a)
    if us:
        yield forest(np.concatenate(us), np.concatenate(vs))


def first_mask(x: np.ndarray, masks: list[int]) -> np.ndarray:
    """The first of the masks under which differing bits x vanish, 0 where there is none."""
    out = np.zeros(len(x), np.int64)
    for m in masks:
        out[(out == 0) & (x & np.int64(m) == 0)] = m
    return out


def nearest_partners(last: int | None, likely: Callable, masks: list[int]) -> Callable:
    """Of each row's likely near pairs in a group the nearest ones, as (smaller rep, larger rep), and who had more, as (rep, rep).

    likely tells by the columns after the label which pairs are likely, and how far apart these are. Of them the first ``last``
    (None: all) are taken, ties by a hash, so that no row becomes everyone's partner, and of these the pairs whose labels (the column
    after fp) differ. A pair that meets in several groups counts in that of its first mask alone.
    """

    def solve(strips: Iterator[Strip], rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mask, rep, fp, label = rows[0], rows[5], rows[6], rows[7]
        for i, j, _ in strips:
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
            ok, apart = likely(rows[8:], i, j)
            i, j, apart = i[ok], j[ok], apart[ok]
            if not len(i):
                continue
            within = np.ones(len(i), bool)
            if last is not None:
                mixed = (rep[i] ^ rep[j]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                order = np.lexsort((mixed ^ mixed >> np.uint64(29), apart, i))
                i, j = i[order], j[order]
                begin = np.concatenate([[True], i[1:] != i[:-1]])
                within = np.arange(len(i)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] < last
            own = first_mask(fp[i] ^ fp[j], masks) == mask[i]
            more = np.unique(np.concatenate([rep[i[own & ~within]], rep[j[own & ~within]]]))
            if len(more):
                yield more, more
            a, b = rep[i[own & within]], rep[j[own & within]]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b)

    return solve


def over_groups(distance: int, solve: Callable, columns: list[str]):
    """Arrow function over rows sorted by group, a bounded number of them at a time."""
    most = 1_600_000 // len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(kept, axis=1)
            change = (rows[:4, 1:] != rows[:4, :-1]).any(0)
            group = np.concatenate([[0], np.cumsum(change)])
            upto = rows.shape[1] if last else int(np.searchsorted(group, group[-1]))
            kept[:] = [] if last else [rows[:, upto:]]
            if upto > 1:
                now = rows[:, :upto]
                for a, b in solve(near_strips(now, group[:upto], distance), now):
                    for f in range(0, len(a), 500_000):
                        yield pa.RecordBatch.from_arrays([pa.array(a[f : f + 500_000]), pa.array(b[f : f + 500_000])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append(np.stack([np.asarray(batch.column(c)) for c in columns]))
                if sum(k.shape[1] for k in kept) >= most:
                    yield from flush(False)
        if kept:
            yield from flush(True)

    return run


def plan_parts(reps: DataFrame, distance: int, most_masked: int = 2) -> list[tuple[list[int], int]]:
    """The parts to probe, by a bounded sample of reps (fp, rep); none if there is no pair."""
    n = reps.count()
    if n < 2:
        return []
    picked = reps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()
    return allocate(np.array([r["fp"] for r in picked], np.int64), n, distance, most_masked)


def probed(reps: DataFrame, parts: list[tuple[list[int], int]], distance: int, solve: Callable, extra: list[str], group_rows: int) -> DataFrame:
    """(a, b) that solve gives for the probe groups of reps (fp, rep, extra...)."""
    if not parts:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    masks = F.array(*(F.lit(m) for m in probe_masks(parts)))
    rows = reps.select("fp", "rep", *extra, F.explode(masks).alias("mask")).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
    # A masked group joins at most 2^t values of a part, so it is large only if one of those is.
    spread = 2 ** max(t for _, t in parts)
    whole_masks = F.array(*(F.lit(m) for m in probe_masks([(p, 0) for p, _ in parts])))
    values = reps.select(F.col("fp"), F.explode(whole_masks).alias("part")).groupBy("part", F.col("fp").bitwiseAND(F.col("part")).alias("v")).agg(F.count("*").alias("n"))
    hot = cut(values.where(F.col("n") > group_rows // spread))
    zero = F.lit(0).cast("long")
    if hot.isEmpty():
        dealt = rows.select("*", zero.alias("lo"), zero.alias("hi"), zero.alias("own"))
    else:
        keys = (
            hot.select("v", "n", "part", F.explode(masks).alias("mask"))
            .where(F.col("mask").bitwiseAND(F.bitwise_not("part")) == 0)
            .groupBy("mask", F.col("v").bitwiseAND(F.col("mask")).alias("val"))
            .agg(F.ceil(F.sum("n") * spread / group_rows).cast("long").alias("blocks"))
        )
        own = F.pmod(F.xxhash64("fp", "rep"), F.col("blocks"))
        other = F.explode(F.sequence(zero, F.col("blocks") - 1))
        dealt = (
            rows.join(keys, ["mask", "val"], "left")
            .withColumn("blocks", F.greatest(F.coalesce("blocks", F.lit(1).cast("long")), F.lit(1).cast("long")))
            .withColumn("own", own)
            .select("fp", "rep", *extra, "mask", "val", "own", other.alias("other"))
            .select("fp", "rep", *extra, "mask", "val", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        )
    order = ["mask", "val", "lo", "hi"]
    columns = [*order, "own", "rep", "fp", *extra]
    spread_out = dealt.select(*columns).repartition(*order).sortWithinPartitions(*order)
    return spread_out.mapInArrow(over_groups(distance, solve, columns), "a long, b long")


def near_links(reps: DataFrame, distance: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between reps (fp, rep) within distance, as forests that keep every component whole."""
    return probed(reps, plan_parts(reps, distance), distance, star_forest, [], group_rows)


def components(docs: DataFrame, words: int = 4, distance: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = cut(fingerprints(docs, words))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    labels = connected_components(near_links(reps, distance, group_rows))
    named = reps.join(labels, reps["rep"] == labels["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
