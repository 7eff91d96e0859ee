"""Order-preserving packing of documents into sequences, by dynamic programming over window cuts.

The ids of a run of documents lie one after another; windows of at most ``limit`` ids cover them. A window may end
at a document's end (free), at a sentence's end (a small truncation penalty) or, where neither comes within a
window, after any id (a large penalty). The programme minimises padding plus penalties:
``best[j] = min(best[i] + limit - (at[j] - at[i])) + penalty[j]`` over the cuts i at most ``limit`` before j. As
``best[i] + at[i]`` doesn't depend on j, the minimum over the sliding range is kept in a monotone queue. At a task's end the
last few windows are planned again by the same programme over all places, in which a window may also have a length that is a
power of two: it needs no padding, but costs a small penalty for a short sequence.

Ids are those of the tokenizer's plain call, without special tokens added; a special token that stands in a text as
such is its own id, as in that call.

Null and empty texts have the end id alone. Texts of any length are cut as needed, and each id lies in exactly one piece. Rows
that repeat are packed as often as they occur; other columns are ignored. Each task packs the rows of its own partition
in their order, a bounded run at a time, without a shuffle; a task that is run again gives the same sequences.
"""

from __future__ import annotations

import itertools
import os
import sys
import threading
import types
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_chunks

LIMIT = 2048
#: Penalties in ids of padding: cuts, and a short sequence whose length is a power of two.
SENTENCE_CUT, ANY_CUT, SHORT = 4, 64, 32
#: Windows at a task's end that are planned again.
LAST_WINDOWS = 3
#: Ids of the run that one programme covers, at least.
RUN_IDS = 1_500_000
#: Words of a form whose ids a worker keeps, and ids of these, at most.
KEPT_WORDS, KEPT_IDS = 400_000, 4_000_000
#: Characters of texts whose words are looked up together.
LOOKED_UP = 2_000_000
#: Seconds that a worker keeps them after a task, for the next one.
KEPT_SECONDS = 4.0
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"


class Table:
    """The words of one form and their ids, in arrays: a word in Python's own objects takes several times as much."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.words = pa.array([], pa.string())
        self.flat, self.size, self.stop, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int64)

    def numbers(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """The numbers of distinct words that are used so many times; new ones are encoded."""
        k = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        new = np.flatnonzero(k < 0)
        if len(new):
            k[new] = np.arange(len(self.words), len(self.words) + len(new))
            fresh = words.take(pa.array(new))
            parts = [self.encode(fresh.slice(f, 20_000)) for f in range(0, len(new), 20_000)]
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in parts)])
            self.size = np.concatenate([self.size, *(size for _, size in parts)])
            self.stop = np.concatenate([self.stop, ends_sentence(fresh)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.words = pa.concat_arrays([self.words, fresh])
            assert len(self.words) == len(self.size)
        self.used[k] += times
        return k

    def forget(self) -> None:
        """If too much is kept, the words used least often go (those used once first) until at most half of it is left."""
        if len(self.size) <= KEPT_WORDS and len(self.flat) <= KEPT_IDS:
            return
        most = 1
        while (keep := self.used > most).sum() > KEPT_WORDS // 2 or self.size[keep].sum() > KEPT_IDS // 2:
            most *= 2
        self.flat = self.flat[np.repeat(keep, self.size)]
        self.size, self.stop, self.used = self.size[keep], self.stop[keep], self.used[keep] // 2
        self.words = self.words.filter(pa.array(keep))


def ends_sentence(words: pa.Array) -> np.ndarray:
    return np.logical_or.reduce([np.asarray(pc.ends_with(words, pattern=c)) for c in ".!?"])


class Words:
    """Ids of texts, through a bounded memory of the ids of white-space-delimited words.

    Byte-level BPE never joins across a single blank or newline: a blank begins the word after it, a newline stands
    alone. So a text whose white space is all single is the concatenation of its words' ids; others go to the tokenizer
    whole. Each distinct word of some texts is looked up once; new ones are encoded together, a newline before each, and parted
    at the newline's id.
    """

    NEWLINE = 198

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core, and the library's threads would keep memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        assert self.tok.encode("\n", add_special_tokens=False).ids == [self.NEWLINE]
        # words after a blank, after a newline (whose ids hold it), and at a text's start
        self.tables = [Table(lambda words, form=form: self.encoded(words, form)) for form in range(3)]

    def encoded(self, words: pa.Array, form: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids a word)."""
        lead = "\n " if form == 0 else "\n"
        some = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 128), len(words)), pa.int32()), words)
        lines = [lead + line for line in pc.binary_join(some, lead).to_pylist()]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        at = np.flatnonzero(ids == self.NEWLINE)
        size = np.diff(np.append(at, len(ids))).astype(np.int32)
        if form != 1:  # the newline isn't theirs
            ids, size = np.delete(ids, at), size - 1
        return ids, size

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids a text, True where an id ends a sentence)."""
        for table in self.tables:
            table.forget()
        plain = [bool(t) and " ".join(t.split()) == t.replace("\n", " ") and not any(x in t for x in self.special) for t in texts]
        number = np.array([t.count(" ") + t.count("\n") + 1 if p else 0 for t, p in zip(texts, plain, strict=True)])
        if any(plain):
            together = "\n".join(t for t, p in zip(texts, plain, strict=True) if p)
            found = pc.split_pattern(pa.array([together.replace("\n", " ")]), " ").values.dictionary_encode()
            distinct, which = found.dictionary, np.asarray(found.indices)
            # the white space before each word: a blank, but for a text's first word and after a newline
            raw = np.frombuffer(together.encode(), np.uint8)
            before = raw[(raw == 32) | (raw == 10)]
            starts = (np.cumsum(number) - number)[np.array(plain)]
            lines = np.setdiff1d(np.flatnonzero(before == 10) + 1, starts, assume_unique=True)
            form = np.zeros(len(which), np.int8)
            form[lines], form[starts] = 1, 2
            k = np.zeros(len(which), np.int64)
            for f, table in enumerate(self.tables):
                at = np.flatnonzero(form == f)
                times = np.bincount(which[at], minlength=len(distinct))
                there = np.flatnonzero(times)
                place = np.zeros(len(distinct), np.int64)
                place[there] = table.numbers(distinct.take(pa.array(there)), times[there])
                k[at] = place[which[at]] + sum(len(t.size) for t in self.tables[:f])
            every = np.concatenate([t.size for t in self.tables]).astype(np.int64)
            size = every[k]
            ends = np.cumsum(size)
            flat = np.concatenate([t.flat for t in self.tables])[np.arange(int(ends[-1])) + np.repeat((np.cumsum(every) - every)[k] - ends + size, size)]
            stop = np.zeros(len(flat), bool)
            stop[ends[np.concatenate([t.stop for t in self.tables])[k]] - 1] = True
            # a newline ends a sentence too: the id before it
            stop[ends[lines - 1] - 1] = True
            upto = np.concatenate([[0], ends])[np.cumsum(number)]
        else:
            flat, stop, upto = np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(len(texts), np.int64)
        sizes = np.diff(np.concatenate([[0], upto]))
        odd = [i for i, (t, p) in enumerate(zip(texts, plain, strict=True)) if t and not p]
        if odd:
            parts, marks = np.split(flat, upto[:-1]), np.split(stop, upto[:-1])
            for i, e in zip(odd, self.tok.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
                marks[i] = np.isin(parts[i], self.ends)
                sizes[i] = len(parts[i])
            flat, stop = np.concatenate(parts), np.concatenate(marks)
        return flat, sizes, stop

    @property
    def ends(self) -> list[int]:
        """Ids of the marks that end a sentence, for texts that aren't split into words."""
        return [self.tok.encode(c, add_special_tokens=False).ids[0] for c in ".!?\n"]


@contextmanager
def kept_words(path: str) -> Iterator[Words]:
    """This worker's memory of words, which outlives a task, and goes when no task has used it for some seconds."""
    state = sys.modules.setdefault("_loomgraph_state", types.ModuleType("_loomgraph_state"))
    if not hasattr(state, "lock"):
        state.lock, state.uses, state.timer, state.path = threading.Lock(), 0, None, None

    def release() -> None:
        with state.lock:
            if not state.uses:
                state.words, state.path = None, None
                give_back()

    with state.lock:
        state.uses += 1
        if state.timer:
            state.timer.cancel()
        if state.path != path:
            state.words, state.path = Words(path), path
        words = state.words
    try:
        yield words
    finally:
        with state.lock:
            state.uses -= 1
            state.timer = threading.Timer(KEPT_SECONDS, release)
            state.timer.daemon = True
            state.timer.start()


def windows(at: list[int], penalty: list[int], limit: int = LIMIT, last: bool = True, short: int | None = None) -> list[int]:
    """The least-cost cuts (places in at) of ids at[0]..at[-1]; neighbours in at lie at most limit apart.

    last False: the last window is left open, and the cuts before it are returned. short: the cost of a window whose length is
    a power of two, instead of its padding.
    """
    n = len(at)
    lengths = [] if short is None else [1 << b for b in range(limit.bit_length()) if 1 << b < limit]
    place = {a: k for k, a in enumerate(at)} if lengths else {}
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # (best + at, place), rising
    for j in range(1, n):
        a = at[j]
        low = a - limit
        while at[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        best[j] = b = key + limit - a + penalty[j]
        back[j] = i
        for size in lengths:
            i = place.get(a - size)
            if i is not None and best[i] + short + penalty[j] < b:
                best[j] = b = best[i] + short + penalty[j]
                back[j] = i
        key = b + a
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if not last:  # the best cut that the open rest can start from
        low = at[-1] - limit
        j = min((k for k in range(n) if at[k] >= low), key=lambda k: best[k])
    cuts = []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def pack_run(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, limit: int, last: bool) -> np.ndarray:
    """The cuts of one run, as numbers of ids before them. doc_ends: ids up to each document's end."""
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[1:][stops] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(np.append(at, len(ids)))
    if (wide := np.flatnonzero(gaps > 64)).size:  # no end in sight: places for a hard cut
        more = np.concatenate([np.arange(at[k] + 64, at[k] + gaps[k], 64) for k in wide])
        penalty[more] = ANY_CUT
        at = np.flatnonzero(penalty >= 0)
    if at[-1] != len(ids):
        at = np.append(at, len(ids))
        penalty[len(ids)] = ANY_CUT
    places = at.tolist()
    cuts = at[windows(places, penalty[at].tolist(), limit, last=False)] if len(places) > 1 else at[:0]
    if last:
        cuts = cuts[: max(0, len(cuts) - LAST_WINDOWS)]
        done = int(cuts[-1]) if len(cuts) else 0
        rest = penalty[done:]
        rest[rest < 0] = ANY_CUT
        rest[0] = 0
        cuts = np.concatenate([cuts, done + np.array(windows(list(range(len(rest))), rest.tolist(), limit, short=SHORT), np.int64)])
    return cuts.astype(np.int64)


def pack(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_words(tokenizer) as words:
            yield from packed(batches, words)

    def packed(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        # what is still open: (doc_id, ids before, all ids) of each document, with the ids and sentence ends
        open_docs: list[tuple[int | None, int, int, int]] = []  # doc_id, start, left, doc_tokens
        rest, rest_stops = [], []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            ids, stops = np.concatenate(rest), np.concatenate(rest_stops)
            ends = np.cumsum([d[2] for d in open_docs])
            cuts = pack_run(ids, ends, stops, limit, last)
            done = int(cuts[-1]) if len(cuts) else 0
            bounds = np.union1d(cuts, np.concatenate([[0], ends[ends <= done]]))
            a, b = bounds[:-1], bounds[1:]
            doc = np.searchsorted(ends, a, side="right")
            seq = np.searchsorted(cuts, a, side="right")
            before = np.concatenate([[0], ends[:-1]])
            own = np.array([d[1] for d in open_docs], np.int64)
            begin = np.concatenate([[0], cuts])
            raw = ids.astype("<u4").tobytes()
            columns = [
                pa.array([open_docs[k][0] for k in doc.tolist()], pa.int64()),
                pa.array(own[doc] + a - before[doc]),
                pa.array(b - a),
                pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
                pa.array([open_docs[k][3] for k in doc.tolist()], pa.int64()),
                pa.array(seq + sequence),
                pa.array(a - begin[seq]),
            ]
            if with_ids:
                columns.append(pa.array([ids[s:e].astype(np.int32) for s, e in zip(a.tolist(), b.tolist(), strict=True)], pa.list_(pa.int32())))
            for k in range(0, len(a), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(k, 20_000) for c in columns], names=[x.split()[0] for x in schema.split(", ")])
            sequence += len(cuts)
            left = int(np.searchsorted(ends, done, side="right"))
            if left < len(open_docs):
                d, start, size, total = open_docs[left]
                taken = done - int(before[left])
                open_docs[:] = [(d, start + taken, size - taken, total), *open_docs[left + 1 :]]
            else:
                open_docs.clear()
            rest[:], rest_stops[:] = [ids[done:]], [stops[done:]]
            held = len(ids) - done

        for doc_ids, texts in text_chunks(batches, most=LOOKED_UP):
            flat, sizes, stops = words.ids([t or "" for t in texts])
            ends = np.cumsum(sizes)
            flat, stops = np.insert(flat, ends, END_ID), np.insert(stops, ends, False)
            rest.append(flat)
            rest_stops.append(stops)
            held += len(flat)
            open_docs.extend((d, 0, int(n) + 1, int(n) + 1) for d, n in zip(doc_ids, sizes, strict=True))
            if held >= RUN_IDS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
