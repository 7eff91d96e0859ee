"""Embedding near-duplicates by dual traversal of cover trees: exact threshold pairs, counted rather than listed.

Vectors are normalised, equal ones become one row with a count. Cosine >= c is a distance <= sqrt(2 - 2c) between unit
vectors. The top of the tree is a cover of a bounded sample; every vector joins its nearest centre, and large cells
are dealt to blocks of a bounded size. Inside a block nested levels with halving radii are built from the top: a node's members
are compared to its centres only, a level's centres are also centres of the next one, each is within the level's radius
of its parent, and each node has its actual covering radius. A level on which hardly any two vectors of a sample share a ball
is left to single vectors without comparing them. Pairs of blocks, then pairs of nodes level by level, are dropped if their centres are further apart than both
radii and the threshold distance; if even the farthest members are within it, all their pairs are counted at once; what is
left at the last level is compared in double precision. A task gives link counts a vector and a forest of its
links, so its output is linear in its input, and components follow from the forests.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different lengths
don't link. Repeated rows are vectors of their own that are linked (a repeated vec_id too). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, forest

#: Vectors in a block; vectors sampled for the top cover, and for whether a level of a block is worth building.
BLOCK, SAMPLE, TRIED = 8_192, 2_048, 512
#: Rows of block pairs up to which they are broadcast (12 bytes each).
BROADCAST_ROWS = 500_000
#: Radii of the nested levels.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Width of the band around a bound in which single vectors decide.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rows_of(column: pa.ListArray) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def greedy_cover(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most so many centres: each next one is the vector furthest from the ones before."""
    centres, apart = [0], np.full(len(x), np.inf)
    while len(centres) < min(most, len(x)):
        apart = np.minimum(apart, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[centres[-1]]))))
        far = int(apart.argmax())
        if apart[far] < SLACK:
            break
        centres.append(far)
    return x[centres]


def net(x: np.ndarray, radius: float, first: np.ndarray) -> np.ndarray:
    """Places of centres, those of first among them, such that each vector is within radius of one: vectors are taken in
    portions, compared to the centres so far, and those that none covers decide among themselves."""
    near = 1 - radius * radius / 2
    centres = first.tolist()
    for f in range(0, len(x), 256):
        part = np.arange(f, min(f + 256, len(x)))
        if centres:
            part = part[~((x[part] @ x[centres].T) >= near).any(1)]
        if len(part):
            inner = x[part] @ x[part].T >= near
            covered = np.zeros(len(part), bool)
            for i in range(len(part)):
                if not covered[i]:
                    centres.append(int(part[i]))
                    covered |= inner[i]
    return np.array(centres, np.int64)


def nested_levels(x: np.ndarray) -> np.ndarray:
    """(levels, n): the place of each vector's centre on each level, a tree: equal on a level means equal above.

    Each node is split by a net of its own members, so the work of a level is members times centres of their node. Where a
    net of a sample has nearly as many centres as the sample has vectors, the level is the vectors themselves.
    """
    n = len(x)
    low = x.astype(np.float32)
    out = np.empty((len(RADII), n), np.int64)
    groups = [np.arange(n)]  # members of the nodes of the level above, the centre first
    for k, radius in enumerate(RADII):
        new: list[np.ndarray] = []
        for members in groups:
            if len(members) == 1:
                out[k, members] = members
                new.append(members)
                continue
            part = low[members]
            tried = part[:: max(1, len(members) // TRIED)][:TRIED]
            if len(members) > TRIED and len(net(tried, radius, np.zeros(0, np.int64))) > 0.95 * len(tried):
                out[k, members] = members  # every vector for itself
                new += [members[i : i + 1] for i in range(len(members))]
                continue
            centres = net(part, radius, np.zeros(1, np.int64))
            best = np.empty(len(members), np.int64)
            for f in range(0, len(members), 4096):
                best[f : f + 4096] = (part[f : f + 4096] @ part[centres].T).argmax(1)
            best[centres] = np.arange(len(centres))
            out[k, members] = members[centres[best]]
            order = np.argsort(best, kind="stable")
            cuts = np.searchsorted(best[order], np.arange(len(centres) + 1))
            for c in range(len(centres)):
                own = members[order[cuts[c] : cuts[c + 1]]]
                centre = members[centres[c]]
                new.append(np.concatenate([[centre], own[own != centre]]))
        groups = new
    return out


class Tree:
    """Node arrays of a block from its nested levels; the last level is the vectors themselves."""

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        order = np.lexsort(levels[::-1])
        self.order, self.x = order, x[order]
        n = len(x)
        self.nodes = []  # per level: first row, size, centre row, radius, children's range on the next level
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        starts = []
        for lev in [*(row[order] for row in levels), np.arange(n)]:
            starts.append(np.flatnonzero(np.concatenate([[True], lev[1:] != lev[:-1]])) if n else np.zeros(0, np.int64))
        for k in range(1, len(starts)):  # equal on a level means equal above
            starts[k] = np.union1d(starts[k], starts[k - 1])
        for k, s in enumerate(starts):
            size = np.diff(np.append(s, n))
            if k < len(levels):
                centre = place[levels[k][order][s]]
                centre = np.where((centre >= s) & (centre < s + size), centre, s)
                d = self.apart(self.x, np.repeat(self.x[centre], size, axis=0))
                radius = np.maximum.reduceat(d, s) if n else d
            else:
                centre, radius = s, np.zeros(len(s))
            self.nodes.append((s, size, centre, radius))
        self.child = [np.searchsorted(starts[k + 1], starts[k]) for k in range(len(starts) - 1)]
        self.children = [np.diff(np.append(self.child[k], len(starts[k + 1]))) for k in range(len(starts) - 1)]

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(1))


def expand(tree: Tree, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes on the next level: (which of the given nodes, child)."""
    n = tree.children[level][node]
    which = np.repeat(np.arange(len(node)), n)
    first = np.repeat(tree.child[level][node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return which, first + np.arange(n.sum())


def dual(a: Tree, b: Tree, same: bool, cosine: float):
    """Yields (rows of a, rows of b) of linked vectors, and (("all"), ...) for whole node pairs; rows are in tree order."""
    eps = float(np.sqrt(2 - 2 * cosine))
    last = len(a.nodes) - 1
    # the first levels compare all their (few) nodes; the level that holds most vectors is one matrix product
    level = 0
    while level < last and len(a.nodes[level + 1][0]) * len(b.nodes[level + 1][0]) <= BLOCK * BLOCK:
        level += 1
        if len(a.nodes[level][0]) > 0.5 * len(a.x):
            break
    ra, rb = a.nodes[level][3], b.nodes[level][3]
    # dual traversal of the top level: pairs of top nodes that can't meet are left out of the product
    d0 = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.nodes[0][2]] @ b.x[b.nodes[0][2]].T)))
    meet = d0 <= a.nodes[0][3][:, None] + b.nodes[0][3][None] + eps + SLACK
    ca, cb = a.x[a.nodes[level][2]].astype(np.float32), b.x[b.nodes[level][2]].astype(np.float32)
    pa_, pb_ = (np.searchsorted(t.nodes[0][0], t.nodes[level][0], side="right") - 1 for t in (a, b))
    reach = min(2.0, float(ra.max() + rb.max() + eps)) + 1e-3
    floor = 1 - reach * reach / 2
    us, vs = [], []
    for p in np.unique(pa_):
        mine = np.flatnonzero(pa_ == p)
        other = np.flatnonzero(meet[p][pb_])
        if not len(other):
            continue
        step = max(1, 2_000_000 // len(other))
        for f in range(0, len(mine), step):
            rows = mine[f : f + step]
            near = np.flatnonzero((ca[rows] @ cb[other].T).ravel() >= floor)
            us.append(rows[near // len(other)])
            vs.append(other[near % len(other)])
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    if same:
        u, v = u[u <= v], v[u <= v]
    while len(u):
        na, nb = a.nodes[level], b.nodes[level]
        keep, every = [], []
        for f in range(0, len(u), 100_000):
            i, j = u[f : f + 100_000], v[f : f + 100_000]
            xa, xb = a.x[na[2][i]], b.x[nb[2][j]]
            bound = na[3][i] + nb[3][j]
            if level == last:
                cos = (xa * xb).sum(1)
                keep.append(np.zeros(len(i), bool))
                every.append((cos >= cosine) & (i != j) if same else cos >= cosine)
            else:
                d = Tree.apart(xa, xb)
                every.append(d + bound <= eps - SLACK)
                keep.append((d <= bound + eps + SLACK) & ~every[-1])
        every, keep = np.concatenate(every), np.concatenate(keep)
        if every.any():
            yield na, nb, u[every], v[every], level == last
        u, v = u[keep], v[keep]
        if level < last and len(u):
            parts_u, parts_v = [], []
            for f in range(0, len(u), 200_000):
                w, cu = expand(a, level, u[f : f + 200_000])
                w2, cv = expand(b, level, v[f : f + 200_000][w])
                cu = cu[w2]
                if same:
                    ok = cu <= cv
                    cu, cv = cu[ok], cv[ok]
                parts_u.append(cu)
                parts_v.append(cv)
            u, v = np.concatenate(parts_u), np.concatenate(parts_v)
            if same and len(u):  # a pair of a node with itself gives each pair of its children once
                both = np.unique(u * np.int64(len(a.nodes[level + 1][0])) + v)
                u, v = both // len(a.nodes[level + 1][0]), both % len(a.nodes[level + 1][0])
        level += 1


def traverse(a: Tree, b: Tree, same: bool, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(forest links u, v; link counts of a's and b's vectors), all in tree order."""
    count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    if same:
        count_b = count_a
    us, vs, held = [], [], 0
    sum_a, sum_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    for na, nb, u, v, single in dual(a, b, same, cosine):
        if single:
            i, j = na[0][u], nb[0][v]
            np.add.at(count_a, i, n_b[j])
            np.add.at(count_b, j, n_a[i])
            us.append(ids_a[i])
            vs.append(ids_b[j])
        else:
            for i, j in zip(u.tolist(), v.tolist(), strict=True):
                ra, rb = slice(na[0][i], na[0][i] + na[1][i]), slice(nb[0][j], nb[0][j] + nb[1][j])
                if same and i == j:
                    count_a[ra] += sum_a[ra.stop] - sum_a[ra.start] - n_a[ra]
                else:
                    count_a[ra] += sum_b[rb.stop] - sum_b[rb.start]
                    count_b[rb] += sum_a[ra.stop] - sum_a[ra.start]
                us += [ids_a[ra], np.full(nb[1][j], ids_a[ra.start])]
                vs += [np.full(na[1][i], ids_b[rb.start]), ids_b[rb]]
        held += len(us[-1]) if us else 0
        if held > 1_000_000:
            x, y = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [x], [y], len(x)
    x, y = forest(np.concatenate(us), np.concatenate(vs)) if us else (ids_a[:0], ids_a[:0])
    return x, y, count_a, count_b


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys."""
    kept: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(c)) for c in keys])
        at = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = tuple(k[:, s])
            if kept and key != now:
                yield pa.Table.from_batches(kept)
                kept = []
            now = key
            kept.append(batch.slice(s, e - s))
    if kept:
        yield pa.Table.from_batches(kept)


def similar(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    item = item if item in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{item}>").alias("x"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")).cast(item))
    valid = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", finite) & F.exists("x", lambda v: v != 0)
    rows = cut(rows.withColumn("x", F.when(F.coalesce(valid, F.lit(False)), F.col("x"))))
    reps = cut(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.size(F.first("x")).alias("dim")))
    found = linked(reps, item, cosine, block)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    labels = connected_components(found.where("b is not null").select("a", "b"))
    named = (
        reps.join(counts, F.col("rep") == F.col("a"), "left")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select("x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.join(named, "x", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def linked(reps: DataFrame, item: str, cosine: float, block: int) -> DataFrame:
    """(a, b, n): forests of links (n null), and link counts n of a (b null), over distinct vectors (x, rep, n, dim)."""
    eps = float(np.sqrt(2 - 2 * cosine))
    sizes = {r["dim"]: r["k"] for r in reps.groupBy("dim").agg(F.count("*").alias("k")).collect()}
    centres = {}
    for dim, k in sizes.items():
        picked = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("x").collect()
        centres[dim] = greedy_cover(unit(np.array([r["x"] for r in picked], np.float64)), min(512, max(1, k // block)))
    kind = pa.float32() if item == "float" else pa.float64()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                c = centres[int(dim)]
                dots = unit(rows_of(part.column("x"))) @ c.T
                cell = dots.argmax(1)
                away = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(cell)), cell]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("x", "rep", "n", "dim")), pa.array(cell.astype(np.int32)), pa.array(away)], names=["x", "rep", "n", "dim", "cell", "away"])

    cells = cut(reps.select("x", "rep", "n", "dim").mapInArrow(assign, f"x array<{item}>, rep long, n long, dim int, cell int, away double"))
    stats = cells.groupBy("dim", "cell").agg(F.count("*").alias("k"), F.max("away").alias("radius")).orderBy("dim", "cell").collect()
    spark = reps.sparkSession
    if not stats:
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "n").limit(0)
    # cells are at most as many as the cover has centres; which of them meet is told from their radii
    first, cells_met, at = {}, [], 0
    for dim, c in centres.items():
        own = [r for r in stats if r["dim"] == dim]
        ids, radius = np.array([r["cell"] for r in own]), np.array([r["radius"] for r in own])
        apart = np.sqrt(np.maximum(0, 2 - 2 * (c[ids] @ c[ids].T)))
        for i, j in zip(*np.nonzero(np.triu(apart <= radius[:, None] + radius[None] + eps + SLACK)), strict=True):
            cells_met.append((dim, int(ids[i]), int(ids[j])))
        cells_met += [(dim, int(i), int(i)) for k, i in enumerate(ids) if apart[k, k] > 2 * radius[k] + eps + SLACK]
        for r in own:  # a cell of many vectors is several blocks of about equal size
            first[dim, r["cell"]] = (at, -(-r["k"] // block))
            at += -(-r["k"] // block)
    where = spark.createDataFrame([(d, c, f, k) for (d, c), (f, k) in first.items()], "dim int, cell int, first int, blocks int")
    dealt = cells.join(F.broadcast(where), ["dim", "cell"]).select("x", "rep", "n", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int").alias("block"))
    # the blocks of cells that meet, paired by the executors
    side = lambda c: where.select("dim", F.col("cell").alias(c), F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias(f"block_{c}"))
    met = spark.createDataFrame(cells_met, "dim int, c int, d int").join(side("c"), ["dim", "c"]).join(side("d"), ["dim", "d"])
    low, high = F.least("block_c", "block_d"), F.greatest("block_c", "block_d")
    pairs = met.select(low.alias("low"), high.alias("high")).distinct()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each vector's centre on each level, as the rep of that centre."""
        for t in grouped(batches, ["block"]):
            x, rep = unit(rows_of(t.column("x").combine_chunks())), np.asarray(t.column("rep"))
            levels = rep[nested_levels(x)]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("block", "rep", "n", "x")), pa.array(list(levels.T), pa.list_(pa.int64()))], names=["block", "rep", "n", "x", "levels"])

    trees = cut(dealt.select("block", "rep", "n", "x").repartition("block").sortWithinPartitions("block").mapInArrow(build, f"block int, rep long, n long, x array<{item}>, levels array<long>"))
    pair = F.col("low").cast("long") * F.lit(1 << 31) + F.col("high")
    partners = cut(pairs.select(pair.alias("pair"), F.explode(F.array_distinct(F.array("low", "high"))).alias("block")))
    if partners.count() <= BROADCAST_ROWS:
        partners = F.broadcast(partners)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["pair"]):
            of = np.asarray(t.column("block"))
            sides = []
            for b in np.unique(of):
                part = t.filter(pa.array(of == b))
                x, rep, n = unit(rows_of(part.column("x").combine_chunks())), np.asarray(part.column("rep")), np.asarray(part.column("n"))
                at = np.argsort(rep)
                levels = np.asarray(part.column("levels").combine_chunks().flatten()).reshape(len(rep), -1).T
                tree = Tree(x, at[np.searchsorted(rep[at], levels)])
                sides.append((tree, rep[tree.order], n[tree.order]))
            (ta, ia, na), (tb, ib, nb) = sides[0], sides[-1]
            u, v, ca, cb = traverse(ta, tb, len(sides) == 1, ia, ib, na, nb, cosine)
            held = [(ia, ca)] if len(sides) == 1 else [(ia, ca), (ib, cb)]
            ids, k = np.concatenate([i for i, _ in held]), np.concatenate([c for _, c in held])
            ids, k = ids[k > 0], k[k > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, ids])), pa.array([*v.tolist(), *[None] * len(ids)], pa.int64()), pa.array([*[None] * len(u), *k.tolist()], pa.int64())], names=["a", "b", "n"])

    told = trees.join(partners, "block").repartition("pair").sortWithinPartitions("pair", "block")
    return cut(told.select("pair", "block", "rep", "n", "x", "levels").mapInArrow(compare, "a long, b long, n long"))


def oracle(cosine: float = 0.95) -> str:
    """The same rows in DuckDB, by all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {cosine}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON vec_id = a"""
