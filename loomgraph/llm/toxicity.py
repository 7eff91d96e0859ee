"""Toxicity by weak supervision.

Many lexicon voters (words and word beginnings) and pattern voters say "toxic" or abstain. Besides a general lexicon, voters are
words that go with the label among labelled rows, as one would write voters down from a development set, with a first belief
in each; from there on no label is used. A generative label model has an accuracy for each voter; expectation
maximisation estimates them from how the voters agree over a sample of documents, labelled or not, and the first beliefs
weigh a few rows. Voters whose votes go together are one statement (these correlations are estimated too). A
linear classifier over the voters is then trained on the posterior labels, and scores every whole text. How the posterior
agrees with the labels is in the model, as a check.

Labels are read only from rows that aren't held out, at most ``SAMPLE`` of each label (by a hash of the id), and at most ``MORE``
other rows that aren't held out join them for the label model. Null and empty texts score as no voter voting, which is below
0.5. Without any label the general lexicon and patterns vote alone; where no voter votes in the sample, scores are 0.02. Long
texts are read whole; repeated rows score alike; other columns are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_chunks

#: Labelled rows of each label, and other rows, that are sampled.
SAMPLE, MORE = 1_500, 6_000
#: Voters at most, toxic rows in which one must vote, and how much more often it does so than in others, as a logarithm (1 more for beginnings of words).
VOTERS, LEAST, ODDS = 600, 5, 4.0
#: How sure a voter must be that goes with the label: the logarithm of how unlikely its counts are by chance.
SURE = 13.0
#: Score where nothing votes; accuracy of a voter of which nothing is known, and rows that outweigh it; correlation of votes that
#: go together; accuracy of a pattern of style, which needs other votes beside it.
QUIET, BELIEF, DOUBT, TOGETHER, STYLE = 0.02, 0.7, 4.0, 0.8, 0.1
WORD = re.compile(r"[^\W\d_]+")
#: A general lexicon of insults. fixed values
LEXICON = ["idiot", "moron", "stupid", "scum", "trash", "worthless", "pathetic", "disgusting", "loser", "clown", "imbecile", "filthy", "vermin", "hate you", "shut up", "kill yourself"]
#: Patterns over the whole text. fixed values
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4,}"),
    "marks": re.compile(r"[!?]{3,}"),
    "insult": re.compile(r"\byou(?:'re| are)? (?:an? |such an? )?(?:" + "|".join(w for w in LEXICON if " " not in w) + r")\b", re.I),
    "starred": re.compile(r"\b[a-z][*#@]{2,}[a-z]*\b", re.I),
}
PREFIXES = (4, 5)


def features(text: str | None) -> set[str]:
    """Words (w:), beginnings of longer words (4:, 5:), and patterns (p:) of a whole text."""
    if not text:
        return set()
    low = text.lower()
    words = set(WORD.findall(low))
    out = {f"w:{w}" for w in words}
    for n in PREFIXES:
        out |= {f"{n}:{w[:n]}" for w in words if len(w) > n}
    out |= {f"p:{k}" for k, p in PATTERNS.items() if p.search(text)}
    return out | {f"w:{w}" for w in LEXICON if " " in w and w in low}


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, more: int = MORE) -> DataFrame:
    """(doc_id, toxic, text) of a bounded sample of rows that aren't held out; toxic is null in those taken for their votes only."""
    free = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id").orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(more).withColumn("toxic", F.lit(None).cast("int"))
    for label in (0, 1):
        picked = picked.unionAll(free.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    ids = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most 2 * most + more rows
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def choose_voters(rows: DataFrame, most: int = VOTERS) -> dict[str, float]:
    """Voters and a first belief in each: the general lexicon and patterns, and features that go with the label far more than without
    it, with the share of their labelled rows that are toxic. Features are counted by the executors; only those chosen reach
    the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, marks in text_chunks(batches, ("text", "toxic")):
            on, off = Counter(), Counter()
            for t, y in zip(texts, marks, strict=True):
                (on if y else off).update(features(t))
            names = list(on | off)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([on[f] for f in names], pa.int64()), pa.array([off[f] for f in names], pa.int64())], names=["feature", "on", "off"])

    taught = rows.where("toxic is not null")
    n = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    given = {f"w:{w}": BELIEF for w in LEXICON} | {f"p:{p}": STYLE for p in PATTERNS}
    if not n.get(1):
        return given
    counts = taught.select("text", "toxic").mapInArrow(run, "feature string, on long, off long").groupBy("feature").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    odds = F.log((F.col("on") + 0.1) / (n[1] + 0.2)) - F.log((F.col("off") + 0.1) / (n.get(0, 0) + 0.2))
    part = n[1] / (n[1] + n.get(0, 0))
    of = lambda x, q: F.when(x > 0, x * F.log(x / ((F.col("on") + F.col("off")) * max(q, 1e-9)))).otherwise(0.0)
    sure = of(F.col("on"), part) + of(F.col("off"), 1 - part)
    best = counts.where(F.col("on") >= LEAST).withColumn("odds", odds).where((F.col("odds") > ODDS + F.col("feature").rlike("^[0-9]").cast("int")) & (sure > SURE)).orderBy(F.desc(F.col("odds") * F.sqrt("on")), "feature").limit(most - len(given))
    known = {r["feature"]: (r["on"] + BELIEF) / (r["on"] + r["off"] + 1) for r in best.select("feature", "on", "off").collect()}
    return given | {f: min(x, 0.95) for f, x in known.items()}


def votes_of(rows: DataFrame, voters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes (rows, voters), labels, -1 where there is none) of the sampled rows: bounded by the sample and the voters."""
    place = {f: k for k, f in enumerate(voters)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, marks in text_chunks(batches, ("doc_id", "text", "toxic")):
            cast = [sorted(place[f] for f in features(t) & place.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(cast, pa.list_(pa.int16()))], names=["doc_id", "toxic", "cast"])

    found = sorted(rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, cast array<short>").collect(), key=lambda r: (r["doc_id"], r["cast"]))
    votes = np.zeros((len(found), len(voters)))
    for k, r in enumerate(found):
        votes[k, r["cast"]] = 1
    return votes, np.array([-1 if r["toxic"] is None else r["toxic"] for r in found], np.int64)


def label_model(votes: np.ndarray, belief: np.ndarray | float = BELIEF, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(posterior, accuracies (voters), correlations, prior) of votes (rows, voters), from agreement alone.

    An abstention says nothing. A voter's accuracy, the share of its votes that are right, is what the other voters believe of the
    rows in which it votes, shrunk to ``belief`` by as many rows as ``DOUBT``; nobody's belief in itself counts, nor that of voters
    that go together with it. A row in which nobody else votes speaks only against a voter of little belief. Of such voters' votes in a row only the surest counts: they are one statement.
    """
    n, m = votes.shape
    cast = votes.sum(0)
    both = votes.T @ votes
    # two voters go together if one mostly votes where the other does
    corr = both / np.maximum(np.minimum.outer(cast, cast), 1)
    np.fill_diagonal(corr, 0)
    group = np.arange(m)
    for j, k in zip(*np.nonzero(np.triu(corr > TOGETHER)), strict=True):
        group[group == max(group[j], group[k])] = min(group[j], group[k])
    kinds, group = np.unique(group, return_inverse=True)
    belief = np.broadcast_to(belief, m)
    accuracy = belief
    prior, post = 0.1, np.zeros(n)
    for turn in range(rounds):
        base = np.log(prior / (1 - prior))
        weight = np.maximum(np.log(accuracy / (1 - accuracy)) - base, 0)
        said = np.zeros((n, len(kinds)))  # the surest vote of each group
        for j in range(m):
            np.maximum(said[:, group[j]], votes[:, j] * weight[j], out=said[:, group[j]])
        logit = base + said.sum(1)
        new = np.where(votes.any(1), 1 / (1 + np.exp(-np.clip(logit, -30, 30))), QUIET)
        others = logit[:, None] - said  # what is believed without a group
        heard = (said > 0).sum(1, keepdims=True) - (said > 0) > 0
        believed = heard / (1 + np.exp(-np.clip(others, -30, 30)))
        alone = votes.T @ ~heard  # (voters, groups): rows in which nobody else votes
        alone = alone[np.arange(m), group] * (belief < 0.5)
        accuracy = np.array([believed[:, group[j]] @ votes[:, j] for j in range(m)]) + DOUBT * belief + QUIET * alone
        accuracy /= np.array([heard[:, group[j]] @ votes[:, j] for j in range(m)]) + DOUBT + alone
        accuracy = np.clip(accuracy, 0.05, 0.98)
        prior = float(np.clip(new.mean(), 1e-3, 0.5))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return new, accuracy, corr, prior


def linear(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 0.5, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both labels weighing the same (Adam)."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= weight.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - target) * weight
        g = np.append(x.T @ d + shrink * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights of the voters and the bias; with the label model's estimates, and how it agrees with the labels it never saw."""
    rows = sampled(docs, labels)
    voters = choose_voters(rows)
    votes, truth = votes_of(rows, list(voters))
    if not votes.any():
        return {"weights": {}, "bias": float(np.log(QUIET / (1 - QUIET)))}
    post, rate, corr, prior = label_model(votes, np.array(list(voters.values())))
    w, b = linear(votes, post)
    kept = {f: float(x) for f, x in zip(voters, w, strict=True) if abs(x) > 1e-6}
    told = truth >= 0
    agreement = float(((post >= 0.5) == (truth == 1))[told].mean()) if told.any() else None
    return {"weights": kept, "bias": float(min(b, np.log(0.4 / 0.6))), "accuracies": rate, "correlations": corr, "prior": prior, "agreement": agreement}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    weights, bias = model["weights"], model["bias"]

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = {f[2:]: w for f, w in weights.items() if f[:2] == "w:"}
        starts = [(n, {f[2:]: w for f, w in weights.items() if f[:2] == f"{n}:"}) for n in PREFIXES]
        phrases = [w for w in words if " " in w]
        patterns = [(PATTERNS[f[2:]], w) for f, w in weights.items() if f[:2] == "p:"]
        for column in batches:
            out = []
            for (texts,) in text_chunks([pa.RecordBatch.from_arrays([column], names=["text"])], ("text",)):
                for text in texts:
                    z = bias
                    if text and weights:
                        low = text.lower()
                        seen = set(WORD.findall(low))
                        z += sum(map(words.__getitem__, seen & words.keys()))
                        for n, table in starts:
                            z += sum(map(table.__getitem__, {w[:n] for w in seen if len(w) > n} & table.keys()))
                        z += sum(words[p] for p in phrases if p in low) + sum(w for p, w in patterns if p.search(text))
                    out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.array(out, pa.float64())

    return docs.select("doc_id", scored("text").alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
