"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram (orders 2 to 5 inside a word and its borders) of a text is hashed to a learned
vector; the mean of the vectors goes through a softmax.  A word that repeats the one before it counts as a further
feature.  Training is plain numpy stochastic gradient descent over a bounded sample of labelled rows.

The softmax is linear in the mean vector, so scoring needs one number for each feature instead of a vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import bounded_rows, bounded_sample, map_texts, slim

BITS, ORDERS, DIM = 17, (2, 3, 4, 5), 8
#: Labelled rows that a model learns from at most.
SAMPLE = 4000
EPOCHS, BATCH, RATE = 12, 32, 0.5
#: Steps of SGD at least: few rows are gone over more often.
LEAST_STEPS = 800
_REPEAT, _OFTEN = 0, 8  # the feature of a repeated word, which counts as often as a word's n-grams would


def features(texts: pa.Array):
    """Yields (ids, text numbers' bounds) by kind: for each kind, feature ids in text order and where each text's begin.

    A long text comes alone and gives its kinds piece by piece.
    """
    if len(texts) == 1 and len(parts := tv.pieces(texts)) > 1:
        last = None
        for part in parts:
            yield from features(part)
            words = tv.word_hashes(tv.split(part), folded=False)
            if len(words):
                n = _OFTEN * int(words[0] == last)  # a word that repeats the one before the cut
                yield np.full(n, _REPEAT, np.int64), np.array([0, n])
                last = words[-1]
        return
    t = tv.split(texts)
    n = len(texts)
    words = tv.word_hashes(t, folded=False)
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), t.first
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[t.first[:-1][t.first[:-1] < len(words)]] = False
    at = np.flatnonzero(again)
    yield np.full(_OFTEN * len(at), _REPEAT, np.int64), _OFTEN * np.searchsorted(at, t.first)
    stream, starts = tv.padded(t.data, t.offsets, tv.MARKS)
    for order in ORDERS:
        ids, ok = tv.ngram_ids(stream, order, BITS)
        at = np.flatnonzero(ok)
        yield ids[at].astype(np.int64), np.append(np.searchsorted(at, starts), len(at)) if n else np.zeros(1, np.int64)


@dataclass
class Model:
    vectors: np.ndarray  # (features, DIM)
    weights: np.ndarray  # (2, DIM)
    bias: np.ndarray  # (2,)
    scale: tuple[float, float] = (1.0, 0.0)  # slope and shift of the log-odds, fitted on rows that SGD did not see

    def line(self) -> np.ndarray:
        """What each feature adds to the log-odds of label 1, before the mean."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float64)


def score_texts(texts: pa.Array, line: np.ndarray, bias: float, scale: tuple[float, float]) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, bounds in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(line[ids])])
        total += sums[bounds[1:]] - sums[bounds[:-1]]
        count += np.diff(bounds)
    return 1 / (1 + np.exp(-np.clip(scale[0] * (total / np.maximum(count, 1) + bias) + scale[1], -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of logistic regression of labels on log-odds, by Newton steps with a weak prior for slope 1."""
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * c])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return (a, c) if a > 0 else (1.0, 0.0)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """SGD on four fifths of the rows, calibration on the rest."""
    aside = np.arange(len(rows)) % 5 == 4
    model = train([r for r, x in zip(rows, aside, strict=True) if not x], labels[~aside])
    if 0 < labels[aside].sum() < aside.sum():
        line, bias = model.line(), float(model.bias[1] - model.bias[0])
        model.scale = platt(np.array([r[1] @ line[r[0]] + bias for r, x in zip(rows, aside, strict=True) if x]), labels[aside])
    return model


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """SGD over (feature ids, shares) rows; a gradient is scaled by its feature's past ones (Adagrad)."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    w[0] = -w[1]
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    b = np.array([0.0, np.log(share / (1 - share))], np.float32)
    past_e, past_w = np.full((1 << BITS, 1), 1e-4, np.float32), np.full(w.shape, 1e-2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows))) if rows else 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            grad_w, grad_b = np.zeros_like(w), np.zeros_like(b)
            steps = []
            for i in batch:
                ids, shares = rows[i]
                v = shares @ e[ids] if len(ids) else np.zeros(DIM, np.float32)
                z = w @ v + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                grad_w += np.outer(p, v)
                grad_b += p
                steps.append((ids, shares, p @ w))
            for ids, shares, g in steps:
                past_e[ids, 0] += (shares * shares) * float(g @ g)
                e[ids] -= rate * shares[:, None] * g / np.sqrt(past_e[ids])
            past_w += grad_w**2
            w -= rate * 0.1 * grad_w / np.sqrt(past_w)
            b -= rate * 0.02 * grad_b / len(batch)
    return Model(e, w, b)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE) -> Model:
    """``docs`` has doc_id and text, ``labels`` doc_id and a 0/1 column; at most ``sample`` labelled rows are learned from.

    Null labels and ids do not count; of several labels of an id the largest holds, of several texts the least, and a null
    one counts as empty.  Without labels the score is one half.
    """
    marks = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    picked = bounded_sample(marks.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", sample)
    rows = slim(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")

    def run(chunks):
        for batch, texts in chunks:
            for i in range(len(texts)):
                ids, counts = np.unique(np.concatenate([x for x, _ in features(texts.slice(i, 1))]), return_counts=True)
                shares = (counts / max(1, counts.sum())).astype(np.float32)
                yield {"doc_id": batch.column(0).slice(i, 1), "label": batch.column(2).slice(i, 1), "ids": [ids.astype(np.int32).tobytes()], "shares": [shares.tobytes()]}

    got = sorted(((r.doc_id, r.label, r.ids, r.shares) for r in bounded_rows(map_texts(rows, run, "doc_id bigint, label int, ids binary, shares binary"), "features")), key=lambda r: (r[0], r[2], r[3]))
    return fit_rows([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for _, _, i, s in got], np.array([r[1] for r in got], np.int64))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row: the calibrated probability of label 1, and whether it reaches the threshold.

    A null or empty text has no features and gets the bias alone.  Repeated rows give equal rows, no rows give no rows,
    extra columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast((model.line(), float(model.bias[1] - model.bias[0]), model.scale))

    def run(chunks):
        line, bias, scale = held.value
        for batch, texts in chunks:
            p = score_texts(texts, line, bias, scale)
            yield {"doc_id": batch.column(0), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return map_texts(slim(df, id_col, text_col), run, "doc_id bigint, score double, predicted int")
