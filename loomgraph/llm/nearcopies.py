"""Near copies: candidates by the generalised pigeonhole search over SimHash fingerprints, verified by exact similarity.

Two documents are linked if the Jaccard similarity of their distinct five-word shingles is at least 0.8 and the search pairs them:
fingerprints over a text's distinct words differ in at most ``DISTANCE`` bits (a changed word changes one of those and five
shingles, so near copies stay close; a line repeated many times adds nothing). Texts of one shingle set are one
class from the start. A sketch of 256 bits drops candidates below the similarity where they meet, before any is sent on; what
is left is verified on the whole sets, before anything is reduced. Smaller and larger sets have sketches of their own and are
searched apart, those of sizes between in both searches.

Candidates come in two turns. First each document's two nearest partners by the sketch in a probe group; then, among the documents that had
more, only pairs that weren't verified and whose documents aren't yet in one component. So a group of near copies costs links in
proportion to its size; only documents that are near candidates and yet below the similarity are compared in all pairs.

What a search shuffles grows in proportion to the documents: a part has one masked bit at most, so there are at most 55 probe rows
a document and search, whatever the table's size, of about 60 bytes each.

Null and empty texts are one class. Rows without doc_id take no part. Rows of one doc_id with different texts are different
documents; repeated rows are one. Other columns make no difference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, fresh, text_chunks, without
from .simhash import differing, majority_bits, nearest_partners, plan_parts, probe_masks, probed, shingle_hashes

#: Differing bits of candidates' word fingerprints: on check_s 2 of 8,999 pairs of the similarity lie beyond.
DISTANCE = 10
#: Partners of each document in a probe group that the first turn verifies.
NEAREST = 2
#: Masked bits of a part, at most: with two there would be up to 376 probe rows a document.
MASKED = 1
#: Fingerprints in a probe group beyond which it is dealt out as pairs of blocks, for which each row goes to all blocks.
GROUP_ROWS = 65_536
#: Bins of a sketch, and the deviations from the mean within which pairs of the similarity are kept.
BINS, DEVIATIONS = 256, 3.5
#: Shingles up to which two sets are compared by parities (exact for short texts, crowded for long ones), beyond by minima.
PARITY_MOST = 400
WORDS64 = [f"s{k}" for k in range(BINS // 64)]
#: Partners of one text that are verified in one task; rows of ids up to which they are broadcast (24 bytes each).
PARTNERS, BROADCAST_ROWS = 256, 500_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Two sketches of sorted hashes, 256 bits each: the parity of their number in each range, and a bit of the smallest there."""
    first = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    number = np.diff(np.append(first, len(shingles)))
    full = number > 0
    least = np.zeros(BINS, np.uint64)
    least[full] = shingles[first[full]]
    return np.packbits(np.concatenate([number & 1, (least >> np.uint64(16)).astype(np.int64) & 1]).astype(np.uint8)).view(np.int64)


def word_hashes(text: str | None) -> list[int]:
    """XXH64 of each distinct word, A-Z lowered, punctuation at its ends aside."""
    h = xxhash.xxh64_intdigest
    return [h(w, 7) for w in {w.strip(b".,;:!?") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()}]


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, version, key, n, fp, sketch) for each row: key stands for its set of n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, versions, texts in text_chunks(batches, ("doc_id", "version", "text")):
            sets = [shingle_set(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(versions, pa.int64()),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(majority_bits([word_hashes(t) for t in texts])),
                    pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "version", "key", "n", "fp", "sketch"],
            )

    return docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, key long, n int, fp long, sketch array<long>")


def most_differing(total: np.ndarray, similarity: tuple[int, int], parity: bool) -> np.ndarray:
    """Bits in which the sketches of two sets of the similarity, total shingles together, differ at most."""
    num, den = similarity
    if parity:  # so many shingles are in one of them alone, and these fall into bins
        apart = total * (den - num) / (den + num)
        one, two = (1 - 2 / BINS) ** apart, (1 - 4 / BINS) ** apart
        mean = BINS * (1 - one) / 2
        deviation = np.sqrt(np.maximum(0, mean + BINS * (BINS - 1) * (1 - 2 * one + two) / 4 - mean**2))
        return np.minimum(np.floor(apart), mean + DEVIATIONS * deviation)
    full = BINS * (1 - (1 - 1 / BINS) ** (total * den / (den + num)))
    mean = full * (den - num) / den / 2
    return mean + DEVIATIONS * np.sqrt(mean * (1 - mean / BINS))


def likely(similarity: tuple[int, int], parity: bool) -> Callable:
    """(which pairs (i, j) the sizes and sketches allow, differing bits of these); rows: the size, then the sketch as words of 64 bits."""
    num, den = similarity

    def test(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = rows[0]
        ok = np.minimum(n[i], n[j]) * den >= num * np.maximum(n[i], n[j])
        if not parity:  # two small sets meet in the other search
            ok &= np.maximum(n[i], n[j]) > PARITY_MOST
        at, apart = np.flatnonzero(ok), np.zeros(len(i), np.int64)
        for f in range(0, len(at), 100_000):
            part = at[f : f + 100_000]
            x, y = i[part], j[part]
            apart[part] = sum(differing(w[x], w[y]).astype(np.int64) for w in rows[1:])
            ok[part] = apart[part] <= most_differing(n[x] + n[y], similarity, parity)
        return ok, apart

    return test


def collect_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of frames that are gone once the driver's collector has seen that."""
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of its rows, so that the texts it is joined with aren't shuffled for it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose whole sets have the similarity. rows (key, doc_id, version) names a text of each key.

    The text of each a goes once, ahead of the texts of its b, to each task that has some of these: one for every 256.
    """
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, p = None, np.zeros(0, np.uint64)
        for a, salt, b, texts in text_chunks(batches, ("a", "salt", "b", "text")):
            out = []
            for x, z, y, t in zip(a, salt, b, texts, strict=True):
                if y is None:
                    now, p = (x, z), shingle_set(t, words)
                    continue
                assert now == (x, z)
                q = shingle_set(t, words)
                shared = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                if shared * den >= num * (len(p) + len(q) - shared):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    hubs = cut(pairs.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > PARTNERS))
    salted = pairs.withColumn("salt", F.lit(0).cast("long"))
    if not hubs.isEmpty():
        salted = pairs.join(hubs, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PARTNERS)), F.lit(0).cast("long")).alias("salt"))
    both = salted.select("a", "salt", "b", F.col("b").alias("key")).unionAll(salted.select("a", "salt", F.lit(None).cast("long"), F.col("a")).distinct())
    texts = docs.join(small(both.join(rows, "key").select("doc_id", "version", "a", "salt", "b")), ["doc_id", "version"])
    return texts.select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, words: int, similarity: tuple[int, int], distance: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): (doc_id, version, key) of every row with a doc_id, and (key, doc_id, version, class) of each set."""
    docs = docs.where("doc_id is not null")
    found = cut(prints(docs, words))
    best = F.min(F.struct("doc_id", "version"))
    # of one key all rows have one set, and so one n, fingerprint and sketch
    sets = cut(found.groupBy("key").agg(best.alias("row"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch")).select("key", "row.doc_id", "row.version", "n", "fp", "sketch"))
    named = sets.select("key", "doc_id", "version")
    num, den = similarity
    searches = []
    for parity, sizes in ((True, f"n between 1 and {PARITY_MOST}"), (False, f"n * {den} > {PARITY_MOST} * {num}")):
        sketched = (F.col("sketch")[k + len(WORDS64) * (not parity)].alias(c) for k, c in enumerate(WORDS64))
        reps = sets.where(sizes).select("fp", F.col("key").alias("rep"), F.col("n").cast("long").alias("n"), *sketched)
        searches.append((reps, plan_parts(reps, distance, MASKED), likely(similarity, parity)))

    def met(last: int | None, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        pairs = [
            probed(chosen(reps).select("fp", "rep", "label", "n", *WORDS64), parts, distance, nearest_partners(last, test, probe_masks(parts)), ["label", "n", *WORDS64], group_rows)
            for reps, parts, test in searches
        ]
        return pairs[0].unionAll(pairs[1]).distinct()

    first = cut(met(NEAREST, lambda reps: reps.withColumn("label", F.col("rep"))))
    pairs, more = first.where("a <> b"), first.where("a = b").select(F.col("a").alias("rep"))
    links = cut(verified(pairs, docs, named, words, similarity))
    labels = connected_components(links)
    collect_shuffles(docs.sparkSession)
    if not more.isEmpty():
        crowded = met(None, lambda reps: reps.join(more, "rep", "left_semi").join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")))
        rest = cut(crowded.join(pairs, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            links = links.unionAll(cut(verified(rest, docs, named, words, similarity)))
            labels = connected_components(links)
        collect_shuffles(docs.sparkSession)
    return found.select("doc_id", "version", "key"), named.join(labels, named["key"] == labels["node"], "left").select("key", "doc_id", "version", F.coalesce("component", "key").alias("class"))


def classes(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5), distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, version, class) for every row of docs (doc_id, text) with a doc_id; version is a hash of the text."""
    rows, keys = labelled(docs.select("doc_id", F.xxhash64("text").alias("version"), "text"), words, similarity, distance, group_rows)
    return rows.join(cut(keys.select("key", "class")), "key").select("doc_id", "version", "class")


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5), distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of docs without near copies: of each class the row of the smallest doc_id (ties: by a hash of the text).

    Rows without doc_id are kept. Of rows that repeat both doc_id and text one is kept.
    """
    version = fresh(docs, "version")
    versioned = docs.withColumn(version, F.xxhash64("text"))
    rows, keys = labelled(versioned.select("doc_id", F.col(version).alias("version"), "text"), words, similarity, distance, group_rows)
    best = keys.groupBy("class").agg(F.min(F.struct("doc_id", "version")).alias("best")).select("best.doc_id", "best.version")
    on = ["doc_id", version]
    bad = rows.join(cut(best), ["doc_id", "version"], "left_anti").select("doc_id", F.col("version").alias(version)).distinct()
    kept = without(versioned, bad, on)
    if not rows.groupBy("doc_id", "version").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(on).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)
