"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent n-grams (one to three letters of words padded by a
blank) over a bounded sample of labelled texts; a document's own most frequent n-grams are compared to each
profile by out-of-place distance: the sum over them of how far the ranks lie apart, or the profile's length for
an n-gram that it lacks. The smallest distance wins, ties by language name; the score is 1 - distance / largest
possible distance.

Null texts and texts without a letter: language ``und``, score 0; so are all texts if there is nothing to learn
from. Null languages teach nothing. Letters that no sampled text holds count as one letter. Long texts are
counted whole. Repeated rows and other columns make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, held_out, text_chunks

#: Length of a profile and of a document's ranking.
RANKS = 300
#: Labelled documents a language that are sampled (by a hash of the id) for its profile.
SAMPLE = 2_000


def letters_table() -> np.ndarray:
    """True at the code points below 0x10000 that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


class Grams:
    """Counts the n-grams of a text as integers over a fixed alphabet."""

    def __init__(self, alphabet: str):
        wide = len(alphabet) > 252
        self.bits, self.kind = (21, np.uint64) if wide else (8, np.uint32)
        self.code = np.zeros(0x110000, np.uint32)
        table = letters_table()
        other = 2 + len(alphabet)
        self.code[:0x10000][table] = other
        self.other = other
        for k, c in enumerate(alphabet):
            self.code[ord(c)] = 2 + k  # 1: the blank around words

    def codes(self, text: str) -> np.ndarray:
        """All n-grams of the text, repeats included."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = self.code[cp]
        high = np.flatnonzero(cp >= 0x10000)
        for i in high.tolist():
            if not x[i] and chr(cp[i]).isalpha():
                x[i] = self.other
        keep = np.empty(len(x) + 2, bool)
        y = np.ones(len(x) + 2, self.kind)
        y[1:-1] = np.where(x == 0, 1, x)
        keep[0] = True
        np.logical_or(y[1:] != 1, y[:-1] != 1, out=keep[1:])  # one blank between words
        y = y[keep]
        if len(y) < 3:
            return y[:0]
        b = self.kind(self.bits)
        one = y[y != 1]
        two = (y[:-1] << b) | y[1:]
        three = (two[:-1] << b) | y[2:]
        return np.concatenate([one, two, three[(y[1:-1] != 1)]])

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        all_codes = np.sort(self.codes(text))
        if not len(all_codes):
            return all_codes, np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], all_codes[1:] != all_codes[:-1]]))
        return all_codes[first], np.diff(np.concatenate([first, [len(all_codes)]]))

    def ranking(self, text: str, most: int) -> np.ndarray:
        """The most frequent n-grams, ties by code."""
        code, n = self.counts(text)
        if len(code) > most:
            # all that tie with the last one stay until the stable sort
            least = np.partition(n, len(n) - most)[len(n) - most]
            at = np.flatnonzero(n >= least)
            code, n = code[at], n[at]
        return code[np.argsort(-n, kind="stable")][:most]


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def learn(docs: DataFrame, ranks: int = RANKS, sample: int = SAMPLE) -> dict:
    """Profiles {lang: ranking} over an alphabet, from a bounded sample of labelled rows."""
    taught = learnable(docs)
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"alphabet": "", "profiles": {}}
    million = 1_000_000
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(million, -(-sample * million // n))))))
    picked = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per language, letters and n-grams as text, summed over the task."""
        from collections import Counter

        total: dict[str, Counter] = {}
        for texts, langs in text_chunks(batches, ("text", "lang")):
            alphabet = "".join(sorted(c for c in set().union(*(t.lower() for t in texts)) if c.isalpha()))
            g = Grams(alphabet)
            names = [" ", *alphabet]
            b, mask = g.bits, (1 << g.bits) - 1
            for text, lang in zip(texts, langs, strict=True):
                code, n = g.counts(text)
                into = total.setdefault(lang, Counter())
                for c, k in zip(code.tolist(), n.tolist(), strict=True):
                    into["".join(names[(c >> s & mask) - 1] for s in (2 * b, b, 0) if c >> s & mask)] += k
        rows = [(lang, g, n) for lang, c in total.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])

    counts = cut(picked.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= ranks).collect()
    letters = counts.where(F.char_length("gram") == 1).where("gram <> ' '").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(20_000).collect()
    return {"alphabet": "".join(r["gram"] for r in letters), "profiles": {lang: [r["gram"] for r in sorted((r for r in top if r["lang"] == lang), key=lambda r: r["rank"])] for lang in sorted(sizes)}}


class Classifier:
    def __init__(self, model: dict, ranks: int = RANKS):
        self.g, self.ranks = Grams(model["alphabet"]), ranks
        self.langs = sorted(model["profiles"])
        at = {c: 2 + k for k, c in enumerate(model["alphabet"])} | {" ": 1}
        grams = sorted({g for p in model["profiles"].values() for g in p})
        code = {}
        for g in grams:
            x = 0
            for c in g:
                x = x << self.g.bits | at[c]
            code[g] = x
        order = sorted(grams, key=code.__getitem__)
        self.keys = np.array([code[g] for g in order], self.g.kind)
        place = {g: i for i, g in enumerate(order)}
        self.rank = np.full((len(order) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            for r, g in enumerate(model["profiles"][lang]):
                self.rank[place[g], k] = r

    def __call__(self, text: str | None) -> tuple[str, float]:
        top = self.g.ranking(text, self.ranks) if text and self.langs else ()
        if not len(top):
            return "und", 0.0
        i = np.searchsorted(self.keys, top)
        i[i == len(self.keys)] = 0
        i[self.keys[i] != top] = len(self.keys)
        r = self.rank[i]
        apart = np.where(r < 0, self.ranks, np.abs(r - np.arange(len(top), dtype=np.int32)[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.ranks * len(top))


def classified(text: str, model: dict) -> Column:
    """(lang, score) of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = Classifier(model)
        for column in batches:
            found = [classify(t) for (texts,) in text_chunks([pa.RecordBatch.from_arrays([column], names=["text"])], ("text",)) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"])

    return run.asNondeterministic()(text)  # else the planner may run it once for each use


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score), one row for each row of docs."""
    out = docs.select("doc_id", classified("text", model).alias("found"))
    return out.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def identify(docs: DataFrame, taught: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; the model comes from taught, docs if not given."""
    found = predict(docs, learn(docs if taught is None else taught))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose text has a language (of those named, if any are), which becomes their lang.

    Texts without a letter (null, empty, digits or marks only) go. Where no row teaches a language there is none to tell:
    texts with a letter stay as they are.
    """
    columns, model = docs.columns, learn(docs)
    if not model["profiles"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = fresh(docs, "found")
    lang = F.col(f"{found}.lang")
    out = docs.withColumn(found, classified("text", model)).where(lang != "und" if languages is None else lang.isin(*languages))
    return out.withColumn("lang", lang).select(*columns)
