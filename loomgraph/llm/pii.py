"""Personal data: base expressions, and a character-level bidirectional LSTM with CRF transitions beside them.

The tagger is trained in numpy, from labelled spans (seeded synthetic text by default, any other on request), for what the
expressions can't read: spelled or bracketed addresses, spaced, defanged or dotted numbers, and numbers that a greedy expression swallowed together with their neighbour and then refused. Windows lie on a fixed grid over the whole
text and overlap; each is decoded by Viterbi, a character's tag comes from the window in which it lies most
centrally, and spans are read off the joined tags of the whole text, so one that crosses windows is found once. A tagged
span counts if it passes its kind's own test, and each such test asks for a digit, ``@`` or the word dot. So a window
without any of these is left undecoded unless a span of its neighbour reaches into it: the spans are those of all windows
decoded (a test holds this). Spans that the base expressions found stay as they are; the tagger's are added where they
overlap none.

Null and empty texts have no spans. Long texts are read whole. Repeated rows give repeated results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_chunks

KINDS = ["email", "ip", "card", "phone"]
#: What any span needs.
TRIGGER = r"(?i)[0-9@]|\bdot\b"
#: Window length, and the part in its middle whose tags it gives.
WINDOW, STRIDE = 128, 80
MARGIN = (WINDOW - STRIDE) // 2

# ---- base spans -----------------------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits is taken whole, so it can't start within one
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base expressions' matches."""
    out = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):  # the part before @, scanned backwards
            at = m.start()
            low = at
            while low > free:
                step = max(free, low - 256)
                piece = text[step:low].rstrip(LOCAL)
                low = step + len(piece)
                if piece:
                    break
            if low < at:
                out.append((low, 0, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


AT, DOT = r" ?(?:@|\(at\)|\[at\]| at ) ?", r" ?(?:[.]|\(dot\)|\[dot\]|\[[.]\]| dot ) ?"
MAIL = re.compile(rf"[A-Za-z0-9%+_-]+(?:{DOT}[A-Za-z0-9%+_-]+)*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}}", re.I)
ADDRESS = re.compile(rf"[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}", re.I)


def plausible(kind: int, s: str) -> bool:
    """The kind's own test for a span of the tagger."""
    if kind == 0:
        # without an @ or digits a dot must be spelled: " at " and "[at]" alone are words like others
        return bool(MAIL.fullmatch(s)) and bool(re.search(TRIGGER, s))
    if kind == 1:
        return bool(ADDRESS.fullmatch(s)) and all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    d = digits_of(s)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", s))
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"(?:\+|00)? ?\(?[0-9][0-9 ()./-]*[0-9]", s)) and (s[0] == "+" or len(re.findall(r"[0-9]+", s)) >= 3)


# ---- labelled spans -------------------------------------------------------------------------------------------------


def labelled_sample(n: int = 3_000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Seeded synthetic texts of up to a window with (start, kind, end) spans, and numbers and words that are none."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", weights=[8, 2, 3, 4, 12, 2, 2, 6, 7, 1, 1, 4, 2, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1, 1, 1, 1], k=rng.randint(1, 11)))
    plain = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=[8, 2, 3, 4, 12, 2, 2, 6, 7, 1, 1, 4, 2, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1], k=rng.randint(2, 9)))

    def words(k: int) -> str:
        out = " ".join((pick(["at", "the", "to", "of", "a", "call", "write", "reach", "or"]) if rng.random() < 0.2 else word()) + pick(["", "", "", "", "", ",", "."]) for _ in range(k))
        return out.upper() if rng.random() < 0.1 else out.capitalize() if rng.random() < 0.4 else out

    def mail() -> str:
        at = pick(["@", "@", " @ ", " at ", "(at)", " (at) ", "[at]", " [at] "])
        dot = "." if at in ("@", " @ ") and rng.random() < 0.7 else pick([" dot ", "(dot)", " (dot) ", "[dot]", " [dot] ", ".", " . "])
        if "@" not in at and dot in (".", " . "):
            dot = " dot "
        local = pick([plain(), plain() + pick([".", "_", "-"]) + plain() if dot == "." else plain() + digits(2), plain() + digits(2)])
        out = local + at + plain() + pick(["", digits(1)]) + dot + pick(["com", "org", "net", "de", "example" + dot + "com"])
        return out.upper() if rng.random() < 0.1 else out

    def card() -> str:
        k = rng.randint(13, 16)
        d = digits(k - 1)
        d += str(next(x for x in range(10) if luhn(d + str(x))))
        return pick(["", "", " ", "-", ".", "/", "  "]).join(d[i : i + 4] for i in range(0, k, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{digits(11)}", f"00{rng.randint(11, 99)} {a} {b}{c}", f"+{rng.randint(11, 99)}/{digits(2)}/{digits(7)}"])

    made = [mail, lambda: pick([".", ".", " . ", "[.]", "(dot)", " dot ", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4)), card, phone]
    other = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: digits(rng.randint(1, 8)),
        lambda: digits(rng.randint(17, 24)),
        lambda: f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(12, 40))),
        lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}",
        lambda: f"AKIA{digits(3)}{word().upper()}",
        lambda: f"@{word()}",
        lambda: f"{plain()} at {plain()} the {plain()}",
        lambda: f"{plain()} dot {plain()}",
    ]
    out = []
    for _ in range(n):
        text, spans = words(rng.randint(1, 5)) + pick([" ", " ", "\n", ": "]), []
        for _ in range(rng.choice([1, 1, 2, 3])):
            kind = rng.randint(0, 5)
            s = made[kind]() if kind < 4 else pick(other)()
            if kind < 4:
                spans.append((len(text), kind, len(text) + len(s)))
            # neighbours may touch: a greedy expression swallows both
            text += s + (" " if rng.random() < 0.25 else pick([" ", " ", " ", ". ", ", ", "\n", "!! "]) + words(rng.randint(1, 3)) + " ")
        out.append((text, spans))
    return out


# ---- the tagger -----------------------------------------------------------------------------------------------------

#: Character classes: one each for these, then digit, a-z, A-Z, other letter, white space, anything else, padding.
SINGLE = "@.+-_()[]:,/%=\"' "
CLASSES = len(SINGLE) + 7
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


KEPT: dict[str, object] = {}


def class_table() -> np.ndarray:
    if "table" in KEPT:
        return KEPT["table"]
    n = len(SINGLE)
    t = np.full(0x10000, n + 5, np.uint8)
    for c in range(0x10000):
        s = chr(c)
        if "0" <= s <= "9":
            t[c] = n
        elif "a" <= s <= "z":
            t[c] = n + 1
        elif "A" <= s <= "Z":
            t[c] = n + 2
        elif s.isalpha():
            t[c] = n + 3
        elif s.isspace():
            t[c] = n + 4
    for k, s in enumerate(SINGLE):
        t[ord(s)] = k
    KEPT["table"] = t
    return t


def classes(text: str, table: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(cp, 0xFFFF)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """x: classes (time, batch). Hidden states (time, batch, hidden) and what the backward pass needs."""
    size = wh.shape[0]
    h = np.zeros((x.shape[1], size), np.float32)
    c = np.zeros_like(h)
    states, kept = np.empty((len(x), *h.shape), np.float32), []
    for t in range(len(x)):
        z = wx[x[t]] + h @ wh
        gates = sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[t] = h
        kept.append((i, f, o, g, before, tc, last))
    return states, kept


def lstm_back(x: np.ndarray, kept: list, wh: np.ndarray, dh_all: np.ndarray, classes_n: int) -> tuple[np.ndarray, np.ndarray]:
    size = wh.shape[0]
    dz_all = np.empty((*x.shape, 4 * size), np.float32)
    dh = np.zeros_like(dh_all[0])
    dc = np.zeros_like(dh)
    for t in reversed(range(len(x))):
        i, f, o, g, before, tc, last = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1, out=dz)
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, 4 * size)
    one_hot = np.zeros((len(flat), classes_n), np.float32)
    one_hot[np.arange(len(flat)), x.ravel()] = 1
    lasts = np.concatenate([k[6] for k in kept])
    return one_hot.T @ flat, lasts.T @ flat


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def emissions(x: np.ndarray, p: dict) -> tuple[np.ndarray, tuple]:
    f, kf = lstm(x, p["fx"], p["fh"])
    b, kb = lstm(x[::-1], p["bx"], p["bh"])
    b = b[::-1]
    return f @ p["uf"] + b @ p["ub"] + p["u0"], (f, kf, b, kb)


def gradient(x: np.ndarray, y: np.ndarray, p: dict) -> tuple[float, dict]:
    """Negative log-likelihood of the tags y (time, batch) and its gradient."""
    e, (f, kf, b, kb) = emissions(x, p)
    steps, batch, _ = e.shape
    tr = p["tr"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["st"]
    for t in range(1, steps):
        alpha[t] = logsumexp(alpha[t - 1][:, :, None] + tr, 1) + e[t]
    for t in reversed(range(steps - 1)):
        beta[t] = logsumexp(tr + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = logsumexp(alpha[-1], 1)
    rows = np.arange(batch)
    gold = p["st"][y[0]] + e[0][rows, y[0]]
    for t in range(1, steps):
        gold = gold + tr[y[t - 1], y[t]] + e[t][rows, y[t]]
    de = np.exp(alpha + beta - z[:, None])
    dtr = np.exp(alpha[:-1, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
    dtr -= np.bincount((y[:-1] * TAGS + y[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
    np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
    de /= batch
    g = {"tr": dtr / batch, "st": de[0].sum(0), "u0": de.sum((0, 1)), "uf": np.tensordot(f, de, ([0, 1], [0, 1])), "ub": np.tensordot(b, de, ([0, 1], [0, 1]))}
    g["fx"], g["fh"] = lstm_back(x, kf, p["fh"], de @ p["uf"].T, CLASSES)
    g["bx"], g["bh"] = lstm_back(x[::-1], kb, p["bh"], (de @ p["ub"].T)[::-1], CLASSES)
    return float((z - gold).mean()), g


def fixed_windows(sample: list) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (time, sample) of texts cut or padded to a window."""
    table = class_table()
    x, y = np.full((len(sample), WINDOW), CLASSES - 1, np.uint8), np.zeros((len(sample), WINDOW), np.int64)
    for k, (text, spans) in enumerate(sample):
        c = classes(text, table)[:WINDOW]
        x[k, : len(c)] = c
        for s, kind, end in spans:
            y[k, s:end] = 2 + 2 * kind
            y[k, s : s + 1] = 1 + 2 * kind
    return x.T.copy(), y.T.copy()


def train(sample: list, hidden: int = 28, epochs: int = 9, batch: int = 48, rate: float = 0.02, seed: int = 3) -> dict:
    """Adam over the labelled spans; the same sample and seed give the same weights."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
    p = {"fx": init(CLASSES, 4 * hidden), "fh": init(hidden, 4 * hidden), "bx": init(CLASSES, 4 * hidden), "bh": init(hidden, 4 * hidden), "uf": init(hidden, TAGS), "ub": init(hidden, TAGS), "u0": np.zeros(TAGS, np.float32), "tr": init(TAGS, TAGS), "st": np.zeros(TAGS, np.float32)}
    for k in ("fx", "bx"):
        p[k][:, hidden : 2 * hidden] += 1.0  # remember at first
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    x, y = fixed_windows(sample)
    lengths = np.array([min(len(text) + 4, WINDOW) for text, _ in sample])
    for epoch in range(epochs):
        order = np.argsort(lengths + rng.integers(0, 16, len(lengths)), kind="stable")  # a batch is as long as its longest text
        for i in rng.permutation(-(-len(order) // batch)) * batch:
            at = order[i : i + batch]
            upto = lengths[at].max()
            _, g = gradient(x[:upto, at], y[:upto, at], p)
            step += 1
            now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
            for k, w in p.items():
                gk = np.clip(g[k], -1, 1).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.99 * v[k] + 0.01 * gk * gk
                w -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return p


def trained() -> dict:
    if "model" not in KEPT:
        KEPT["model"] = train(labelled_sample())
    return KEPT["model"]


def viterbi(e: np.ndarray, p: dict) -> np.ndarray:
    """Best tags (time, batch); I follows only B or I of its kind."""
    tr = p["tr"].copy()
    st = p["st"].copy()
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        bad = [a for a in range(TAGS) if a not in (inside, inside - 1)]
        tr[bad, inside] = -1e4
    back = np.empty(e.shape, np.int8)
    score = e[0] + st
    for t in range(1, len(e)):
        s = score[:, :, None] + tr
        back[t] = s.argmax(1)
        score = np.take_along_axis(s, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
    out = np.empty(e.shape[:2], np.int8)
    out[-1] = score.argmax(1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = back[t][rows, out[t]]
    return out


def decoded(codes: list[np.ndarray], places: list[tuple[int, int]], tags: list[np.ndarray], p: dict, batch: int = 1024) -> None:
    """Sets the tags of the middle of each window (text, number on the grid)."""
    for i in range(0, len(places), batch):
        part = places[i : i + batch]
        x = np.full((WINDOW, len(part)), CLASSES - 1, np.uint8)
        for j, (k, g) in enumerate(part):
            low = g * STRIDE - MARGIN
            c = codes[k][max(low, 0) : low + WINDOW]
            x[max(-low, 0) : max(-low, 0) + len(c), j] = c
        best = viterbi(emissions(x, p)[0], p)
        for j, (k, g) in enumerate(part):
            a, b = g * STRIDE, min((g + 1) * STRIDE, len(codes[k]))
            tags[k][a:b] = best[MARGIN : MARGIN + b - a, j]


def tagged_spans(texts: list[str], p: dict, everywhere: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the tagger in each whole text; everywhere: decode all windows, also those that can't matter."""
    table = class_table()
    codes = [classes(t, table) for t in texts]
    tags = [np.zeros(len(c), np.int8) for c in codes]
    done: set[tuple[int, int]] = set()
    if everywhere:
        now = {(k, g) for k, c in enumerate(codes) for g in range(-(-len(c) // STRIDE))}
    else:
        now = {(k, m.start() // STRIDE) for k, t in enumerate(texts) for m in re.finditer(TRIGGER, t)}
    while now:
        decoded(codes, sorted(now), tags, p)
        done |= now
        reached = set()
        for k, g in now:  # a span may reach into the window before or after
            a, b = g * STRIDE, min((g + 1) * STRIDE, len(codes[k]))
            if a and tags[k][a]:
                reached.add((k, g - 1))
            if b < len(codes[k]) and tags[k][b - 1]:
                reached.add((k, g + 1))
        now = reached - done
    out = []
    for text, y in zip(texts, tags, strict=True):
        found = []
        if y.any():
            kind = np.where(y > 0, (y + 1) // 2, 0)
            before = np.concatenate([[0], kind[:-1]])
            begin = np.flatnonzero((kind > 0) & ((y % 2 == 1) | (before != kind)))
            # a span ends before the next one begins or where its kind does
            stop = np.flatnonzero(np.concatenate([((y % 2 == 1) | (before != kind))[1:], [True]])) + 1
            for s, e in zip(begin.tolist(), stop[np.searchsorted(stop, begin, side="right")].tolist(), strict=True):
                around = text[max(s - 1, 0) : s] + text[e : e + 1]
                if plausible(int(kind[s]) - 1, text[s:e]) and not re.search("[A-Za-z0-9]", around):
                    found.append((s, int(kind[s]) - 1, e))
        out.append(found)
    return out


def find(texts: list[str], p: dict) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    out = []
    for text, more in zip(texts, tagged_spans(texts, p), strict=True):
        base = base_spans(text)
        taken = np.zeros(len(text) + 1, bool) if more else None
        if more:
            for s, _, e in base:
                taken[s:e] = True
        out.append((base, [x for x in more if not taken[x[0] : x[2]].any()]))
    return out


SPANS = "array<struct<start:int,kind:string,end:int>>"


def spans_of(text: Column, model: dict) -> Column:
    """(base, added) of a text column, each sorted by start. Only texts that can hold a span leave the JVM."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    @F.arrow_udf(f"struct<base:{SPANS},added:{SPANS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shown = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
        for column in batches:
            found: list[tuple[list, list]] = []
            for (texts,) in text_chunks([pa.RecordBatch.from_arrays([column], names=["text"])], ("text",)):
                held = [k for k, t in enumerate(texts) if t]
                part: list[tuple[list, list]] = [([], [])] * len(texts)
                for k, f in zip(held, find([texts[k] for k in held], model), strict=True):
                    part[k] = f
                found += part
            yield pa.StructArray.from_arrays([pa.array([shown(f[k]) for f in found], kind) for k in (0, 1)], names=["base", "added"])

    return run.asNondeterministic()(F.when(text.rlike("[0-9@]") | F.contains(F.lower(text), F.lit("dot")), text))  # else the planner may run it once for each use


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, base, added): spans of each row's text, sorted."""
    out = docs.select("doc_id", spans_of(F.col("text"), trained() if model is None else model).alias("found"))
    return out.select("doc_id", "found.base", "found.added")


def digest(found: DataFrame) -> DataFrame:
    rank = F.create_map(*(x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))))
    ordered = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = lambda c: F.array_join(F.transform(ordered(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets; n_chars follows where there is such a column."""
    columns, found = docs.columns, fresh(docs, "found")
    out = docs.withColumn(found, spans_of(F.col("text"), trained() if model is None else model))
    spans = F.array_sort(F.concat(f"{found}.base", f"{found}.added"))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh_one = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh_one, F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"))

    text = F.aggregate(spans, empty, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    out = out.withColumn("text", F.when(F.size(spans) > 0, text).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)
