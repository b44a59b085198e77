"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its hashed word vector beside the mean of its hashed character 4-gram vectors.  Overlapping windows
of words go through a GRU in each direction, attention pools the states, and a linear layer scores the window.  A text
has the score of its worst window: every window of the whole text is scored.

Training is numpy only, over every window of the sampled texts: first all windows carry their text's label, then only each
text's worst window does (multiple instance learning).  The first number of a word's and of a 4-gram's vector starts at the
log-odds of the label given that it occurs in a text, less a standard error, so that a few labels are enough to learn from.
Log-odds are calibrated on texts that training did not see, and to the labels' true share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import bounded_rows, bounded_sample, map_texts, slim, stored
from quarrion.llm.quality import platt

WORD_BITS, CHAR_BITS, GRAM = 15, 15, 4
DIM, HIDDEN, ATTEND = 8, 8, 8
#: Words of a window, and words from one window's start to the next.
WINDOW, STRIDE = 24, 18
#: A model learns from so many texts of each label at most, of so many bytes together, none of more than TEXT_BYTES.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 1500, 8 << 20, 2 << 20
#: Epochs over all windows and over worst ones, of these so many steps at least: few texts are gone over more often.
WHOLE_EPOCHS, WORST_EPOCHS, LEAST_STEPS, BATCH = 1, 14, 100, 256
#: Texts that must hold a word or 4-gram for its log-odds to count, and what is added to their number to shrink them.
PRIOR_TEXTS, SHRINK = 3, 4
_WORDS = 1 << 15  # words that are scored at once


@dataclass
class Words:
    """Inputs of a run of words: word ids, and the 4-gram ids of all words with each word's first (n + 1)."""

    ids: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def inputs(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of a chunk of texts, and each text's first word; a long text, which comes alone, is read piece by piece."""
    if len(texts) == 1 and len(parts := tv.pieces(texts)) > 1:
        words, first = _joined([inputs(p)[0] for p in parts])
        return words, first[[0, -1]]
    t = tv.split(texts)
    ids = (tv.word_hashes(t) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    stream, _ = tv.padded(t.data, t.offsets, tv.FOLDED)
    grams, ok = tv.ngram_ids(stream, GRAM, CHAR_BITS)
    at = np.flatnonzero(ok)
    # the second character of a 4-gram lies in its word; in the stream, byte b of text i stands at b + i + 1
    shift = np.repeat(np.arange(len(t)), np.diff(t.first)) + 1
    return Words(ids, grams[at].astype(np.int32), np.append(np.searchsorted(at + 1, t.starts + shift), len(at))), t.first


def window_starts(words: int) -> np.ndarray:
    """Starts of the overlapping windows that cover so many words (one, empty, for none)."""
    return np.arange(0, max(1, words - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    word: np.ndarray
    char: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def new(seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
        net = Net(draw(1 << WORD_BITS, DIM, by=0.1), draw(1 << CHAR_BITS, DIM, by=0.1))
        for d in "fb":
            net.p |= {f"W{d}": draw(2 * DIM, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        net.p |= {"A": draw(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "w": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        return net

    def embed(self, words: Words) -> np.ndarray:
        """(words, 2 DIM)."""
        x = np.zeros((len(words.ids), 2 * DIM), np.float32)
        x[:, :DIM] = self.word[words.ids]
        n = np.diff(words.first)
        some = np.flatnonzero(n)
        if len(some):
            x[some, DIM:] = np.add.reduceat(self.char[words.grams], words.first[some], axis=0) / n[some, None]
        return x

    def _scan(self, g: np.ndarray, at: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (time, windows, HIDDEN) of one direction; ``g`` holds the words' gate inputs."""
        u, steps = self.p["U" + d], range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((len(at), HIDDEN), np.float32)
        out = np.empty((WINDOW, len(at), HIDDEN), np.float32)
        for t in steps:
            x, hu = g[at[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = np.where(live[:, t, None], n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, hu[:, 2 * HIDDEN :], z, r, n))
            out[t] = h = new
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, live: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Log-odds of windows: ``x`` word inputs, ``at`` (windows, WINDOW) word numbers, ``live`` which count."""
        states, tapes = [], []
        for d in "fb":
            keep: list | None = [] if tape is not None else None
            states.append(self._scan(x @ self.p["W" + d] + self.p["c" + d], at, live, d, keep))
            tapes.append(keep)
        h = np.concatenate(states, 2)
        q = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(live.T, q @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(0)) * live.T
        e /= np.maximum(e.sum(0), 1e-9)
        c = np.einsum("tn,tnh->nh", e, h)
        if tape is not None:
            tape |= {"h": h, "q": q, "e": e, "c": c, "scans": tapes}
        return c @ self.p["w"] + self.p["b"]

    def backward(self, x: np.ndarray, at: np.ndarray, live: np.ndarray, tape: dict, dz: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of ``x``."""
        p, h, q, e = self.p, tape["h"], tape["q"], tape["e"]
        g = {"w": tape["c"].T @ dz, "b": dz.sum(keepdims=True)}
        dc = dz[:, None] * p["w"]
        dh = e[:, :, None] * dc
        de = np.einsum("nh,tnh->tn", dc, h)
        de = e * (de - (e * de).sum(0))
        g["v"] = np.einsum("tn,tna->a", de, q)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"], g["a"] = np.einsum("tnh,tna->ha", h, dq), dq.sum((0, 1))
        dh += dq @ p["A"].T
        dx = np.zeros_like(x)
        for d, own, scan in zip("fb", (dh[:, :, :HIDDEN], dh[:, :, HIDDEN:]), tape["scans"], strict=True):
            u, w = p["U" + d], p["W" + d]
            gw, gu, gc = np.zeros_like(w), np.zeros_like(u), np.zeros_like(p["c" + d])
            back = np.zeros((len(at), HIDDEN), np.float32)
            for t, before, hun, z, r, n in reversed(scan):
                total = own[t] + back
                on = total * live[:, t, None]
                dn = on * (1 - z) * (1 - n * n)
                gate = np.concatenate([on * (before - n) * z * (1 - z), dn * hun * r * (1 - r), dn], 1)
                inner = gate.copy()
                inner[:, 2 * HIDDEN :] *= r
                gu += before.T @ inner
                gw += x[at[:, t]].T @ gate
                gc += gate.sum(0)
                np.add.at(dx, at[:, t], gate @ w.T)
                back = inner @ u.T + on * z + total * ~live[:, t, None]
            g |= {"W" + d: gw, "U" + d: gu, "c" + d: gc}
        return g, dx


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts whose words begin at ``first``: first words, the texts' ends, and each text's first window (n + 1)."""
    starts = [window_starts(n) for n in np.diff(first)]
    bounds = np.append(0, np.cumsum([len(s) for s in starts])).astype(np.int64)
    return np.concatenate([s + f for s, f in zip(starts, first[:-1], strict=True)]), np.repeat(first[1:], np.diff(bounds)), bounds


def layout(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows (the rest of a short one points to word 0), and which count."""
    at = starts[:, None] + np.arange(WINDOW)
    live = at < ends[:, None]
    return np.where(live, at, 0), live


def window_scores(net: Net, words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-odds of windows in order of their starts; words are embedded for a bounded number of windows at once."""
    z = []
    for i in range(0, len(starts), _WORDS // STRIDE):
        s, e = starts[i : i + _WORDS // STRIDE], ends[i : i + _WORDS // STRIDE]
        lo, hi = int(s[0]), int(min(e[-1], s[-1] + WINDOW))
        part = Words(words.ids[lo:hi], words.grams[words.first[lo] : words.first[hi]], words.first[lo : hi + 1] - words.first[lo])
        at, live = layout(s - lo, e - lo)
        z.append(net.forward(net.embed(part) if hi > lo else np.zeros((1, 2 * DIM), np.float32), at, live))
    return np.concatenate(z)


def worst(net: Net, words: Words, first: np.ndarray) -> np.ndarray:
    """The largest log-odds of any window of each text."""
    starts, ends, bounds = windows(first)
    return np.maximum.reduceat(window_scores(net, words, starts, ends), bounds[:-1]).astype(np.float64)


def _joined(texts: list[Words]) -> tuple[Words, np.ndarray]:
    grams = np.append(0, np.cumsum([len(t.grams) for t in texts]))
    starts = np.concatenate([t.first[:-1] + g for t, g in zip(texts, grams[:-1], strict=True)] + [grams[-1:]])
    return Words(np.concatenate([t.ids for t in texts]), np.concatenate([t.grams for t in texts]), starts), np.append(0, np.cumsum([len(t.ids) for t in texts]))


class _Steps:
    """Adam for the dense parameters, Adagrad for the rows of the vector tables."""

    def __init__(self, net: Net, rate: float = 0.01):
        self.net, self.rate, self.n = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.word, self.char = np.full(len(net.word), 1e-4, np.float32), np.full(len(net.char), 1e-4, np.float32)

    def _rows(self, table: np.ndarray, past: np.ndarray, ids: np.ndarray, grad: np.ndarray) -> None:
        used, inverse = np.unique(ids, return_inverse=True)
        total = np.zeros((len(used), table.shape[1]), np.float32)
        np.add.at(total, inverse, grad)
        past[used] += (total * total).sum(1)
        table[used] -= 5 * self.rate * total / np.sqrt(past[used])[:, None]

    def step(self, words: Words, at: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        net, self.n = self.net, self.n + 1
        need, local = np.unique(at, return_inverse=True)
        n = words.first[need + 1] - words.first[need]
        grams = words.grams[np.repeat(words.first[need], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        part = Words(words.ids[need], grams, np.append(0, np.cumsum(n)))
        local, tape, x = local.reshape(at.shape), {}, net.embed(part)
        dz = ((_sigmoid(net.forward(x, local, live, tape)) - y) * weight / len(y)).astype(np.float32)
        g, dx = net.backward(x, local, live, tape, dz)
        for k, v in g.items():
            self.m[k] += 0.1 * (v - self.m[k])
            self.s[k] += 0.01 * (v * v - self.s[k])
            net.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.99**self.n)) + 1e-6)
        self._rows(net.word, self.word, part.ids, dx[:, :DIM])
        owner = np.repeat(np.arange(len(need)), n)
        self._rows(net.char, self.char, part.grams, dx[owner, DIM:] / n[owner, None])


def log_odds(ids: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """What the occurrence of each of so many features in a text says of its label: log-odds a standard error nearer to
    zero, shrunk where few texts hold the feature."""
    n = np.zeros((2, size))
    for i, y in zip(ids, labels, strict=True):
        n[int(y), np.unique(i)] += 1
    texts = np.array([(labels == 0).sum(), (labels == 1).sum()])
    odds = np.log((n[1] + 0.5) / (texts[1] + 1)) - np.log((n[0] + 0.5) / (texts[0] + 1))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5)), 0)
    held = n.sum(0)
    return np.where(held >= PRIOR_TEXTS, sure * held / (held + SHRINK), 0).astype(np.float32)


def train(texts: list[Words], labels: np.ndarray, share: float, seed: int = 7) -> Net:
    """Learn from texts with words; ``share`` is the share of label 1 among all labelled rows."""
    net, rng = Net.new(seed), np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    if not len(texts) or len(set(labels[~aside])) < 2:
        net.p["w"][:] = 0
        net.p["b"][:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return net
    own, seen = labels[~aside].astype(np.float32), [t for t, x in zip(texts, aside, strict=True) if not x]
    net.word[:, 0] = log_odds([t.ids for t in seen], own, len(net.word))
    net.char[:, 0] = log_odds([t.grams for t in seen], own, len(net.char))
    words, first = _joined(seen)
    starts, ends, bounds = windows(first)
    y = np.repeat(own, np.diff(bounds))
    steps = _Steps(net)
    weigh = lambda y: np.where(y > 0, 0.5 / max(y.mean(), 0.05), 0.5 / max(1 - y.mean(), 0.05)).astype(np.float32)
    for _ in range(WHOLE_EPOCHS):
        order = rng.permutation(len(starts))
        for i in range(0, len(order), BATCH):
            b = order[i : i + BATCH]
            steps.step(words, *layout(starts[b], ends[b]), y[b], weigh(y[b]))
    epochs = max(WORST_EPOCHS, -(-LEAST_STEPS * (BATCH // 4) // len(seen)))
    for epoch in range(epochs):
        steps.rate = 0.01 * (1 - epoch / (2 * epochs))
        z = window_scores(net, words, starts, ends)
        pick = np.array([lo + int(np.argmax(z[lo:hi])) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)])
        order = rng.permutation(len(pick))
        for i in range(0, len(order), BATCH // 4):
            b = pick[order[i : i + BATCH // 4]]
            steps.step(words, *layout(starts[b], ends[b]), own[order[i : i + BATCH // 4]], np.ones(len(b), np.float32))
    if 0 < labels[aside].sum() < aside.sum():
        held, first = _joined([t for t, x in zip(texts, aside, strict=True) if x])
        a, c = platt(worst(net, held, first), labels[aside].astype(np.float64))
        drawn = float(labels[aside].mean())
        net.scale = (a, c + float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))))  # both labels were drawn alike
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE) -> Net:
    """``docs`` has doc_id and text, ``labels`` doc_id and a 0/1 column.

    At most ``sample`` rows of each label are learned from, of SAMPLE_BYTES of text together; texts of over TEXT_BYTES take
    no place in the sample.  Of these texts every window counts.  Null labels, ids and texts do not count; of several labels
    of an id the largest holds, of several texts the least.  Without both labels the score is the labels' share.
    """
    marks = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    marks = stored(marks.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    share = marks.agg(F.avg("label")).first()[0]
    docs = slim(docs, "doc_id", "text").where("text is not null")
    sizes = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")).where(F.col("bytes") <= TEXT_BYTES)
    sizes = sizes.join(marks, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("bytes").alias("bytes"))
    picked = bounded_sample(stored(sizes, "sizes"), "doc_id", sample, "label")
    sums = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("sum", sums).where(F.col("sum") <= SAMPLE_BYTES).select("doc_id", "label")
    rows = docs.where(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

    def run(chunks):
        for batch, texts in chunks:
            for i in range(len(texts)):
                w, _ = inputs(texts.slice(i, 1))
                if len(w.ids):
                    yield {"doc_id": batch.column(0).slice(i, 1), "label": batch.column(2).slice(i, 1), "ids": [w.ids.tobytes()], "grams": [w.grams.tobytes()], "first": [w.first.astype(np.int32).tobytes()]}

    got = sorted(((r.doc_id, r.label, r.ids, r.grams, r["first"]) for r in bounded_rows(map_texts(rows, run, "doc_id bigint, label int, ids binary, grams binary, first binary"), "words")), key=lambda r: r[0])
    texts = [Words(np.frombuffer(i, np.int32), np.frombuffer(g, np.int32), np.frombuffer(f, np.int32).astype(np.int64)) for _, _, i, g, f in got]
    return train(texts, np.array([r[1] for r in got], np.int64), min(max(share if share is not None else 0.5, 1e-3), 1 - 1e-3))


def score(df: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row: the probability of label 1, and whether it reaches the threshold.

    All overlapping windows of the whole text are scored; a null or empty text, or one without words, has one empty
    window.  Repeated rows give equal rows, no rows give no rows, extra columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(net)

    def run(chunks):
        net = held.value
        a, c = net.scale
        for batch, texts in chunks:
            words, first = inputs(texts)
            p = _sigmoid(np.clip(a * worst(net, words, first) + c, -30, 30))
            yield {"doc_id": batch.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return map_texts(slim(df, id_col, text_col), run, "doc_id bigint, score double, predicted int")
