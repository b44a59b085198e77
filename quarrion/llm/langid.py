"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (orders 2 to 4 inside words), weighted by sqrt(count) x idf and
normalised.  Each language has several centroids, found by spherical k-means over a bounded sample of its texts; a
text gets the language of the nearest centroid by cosine.  A text farther from every centroid than the rejection
distance is rejected.  That distance depends on how many different n-grams a text has, since short texts are far from
any centroid; it is learned from texts, and short parts of them, that the centroids were not learned from: their distances
to their own language, and to all others as if theirs had not been learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import bounded_rows, bounded_sample, map_texts, release_memory, slim, small_batches, stored, text_batches

BITS, ORDERS = 14, (2, 3, 4)
#: Texts of each language that a model learns from at most, and centroids of a language.
SAMPLE, CENTROIDS = 600, 3
#: Languages that a model may know: a bound on its size, 200 KB for each.
MOST_LANGS = 400
UNKNOWN = "und"
_ROWS = 64
#: Words of the parts by which the distances of short texts are learned.
PART_WORDS = (1, 2, 4, 8, 16, 32, 64)
#: Steps of text size (2 for each doubling of the different n-grams) and the texts of each language in one that count.
STEPS, LEAST_TEXTS = 2, 20
#: Share of learned languages' texts that may fall below the limit, and of other languages' that may rise above it, at either end.
OWN_TAIL, OTHER_TAIL = 0.001, 0.99


def count_ngrams(texts: pa.Array) -> np.ndarray:
    """A row of n-gram counts for each text (float32)."""
    if len(texts) == 1 and len(parts := tv.pieces(texts)) > 1:
        return sum(count_ngrams(p) for p in parts)
    data, offsets = tv.raw(texts)
    stream, at = tv.padded(data, offsets, tv.LETTERS)
    bounds = np.append(at, len(stream))
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for n in ORDERS:
        ids, ok = tv.ngram_ids(stream, n, BITS)
        for i in range(len(texts)):
            part = slice(bounds[i], min(bounds[i + 1], len(ids)))
            out[i] += np.bincount(ids[part][ok[part]], minlength=1 << BITS)
    return out


def has_letter(text: bytes) -> bool:
    """Whether any character is a Unicode letter."""
    b = np.frombuffer(text, np.uint8)
    low = b | 0x20
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((b >= 128).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # (grams,)
    centroids: np.ndarray  # (languages x centroids, grams), rows of length one
    owner: np.ndarray  # the language of each centroid
    sizes: np.ndarray  # ascending: log2 of the different n-grams of a text
    reject: np.ndarray  # texts of such a size with a cosine below this are rejected

    def limits(self, counts: np.ndarray) -> np.ndarray:
        """The least cosine, for each text, that is not rejected: linear between the sizes, constant beyond them."""
        return np.interp(np.log2(np.maximum((counts > 0).sum(1), 1)), self.sizes, self.reject)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """(texts, languages): the cosine to the nearest centroid of each language."""
        x = np.sqrt(counts) * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        sims = x @ self.centroids.T / np.maximum(norm, 1e-9)[:, None]
        best = np.full((len(x), len(self.langs)), -1.0)
        for c, owner in enumerate(self.owner):
            np.maximum(best[:, owner], sims[:, c], out=best[:, owner])
        return best


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row and then the rows farthest from those chosen."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, 1)
        for c in range(k):
            if (near == c).any():
                m = x[near == c].mean(0)
                centres[c] = m / max(1e-9, float(np.linalg.norm(m)))
    return centres


def _parts(texts: pa.Array) -> tuple[list[int], pa.Array]:
    """The middle PART_WORDS words of each longer text: its row, and the part."""
    t = tv.split(texts)
    of, parts = [], []
    for i in range(len(t)):
        lo, hi = int(t.first[i]), int(t.first[i + 1])
        for n in PART_WORDS:
            if n < hi - lo:
                at = lo + (hi - lo - n) // 2
                of.append(i)
                parts.append(t.data[t.starts[at] : t.ends[at + n - 1]].tobytes().decode("utf-8", "replace"))
    return of, pa.array(parts, pa.large_string())


def reject_limits(sizes: np.ndarray, own: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, least cosines) from held-out texts: log2 of their n-grams, cosines to their own language and to all others.

    Halfway between the two where they can be told apart at a size; where not, as with single words, what keeps the texts of
    learned languages.  Without another language, half of what such texts reach.  Sizes of few texts take the next size's.
    """
    step = np.round(sizes * STEPS)
    at, limits = [], []
    for x in np.unique(step):
        here = step == x
        if here.sum() < min(LEAST_TEXTS, len(sizes)):
            continue
        low = float(np.quantile(own[here], OWN_TAIL))
        high = 0.0 if other is None else float(np.quantile(other[here], OTHER_TAIL))
        at.append(x / STEPS)
        limits.append((low + high) / 2 if high < low else low)
    return np.array(at or [0.0]), np.maximum(limits or [0.0], 0.0)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from at most ``sample`` texts of each language (the bound); rows with a null language or text do not count.

    Texts are counted on the executors; the driver gets their sparse counts, bounded by the sample and 2^BITS, and of the
    distances by which rejection is learned three numbers for each text and part.  Of rows that
    share an id and a language one is learned from, the least by its text.  Without any row to learn from the model knows no
    language and rejects every text.  More than MOST_LANGS languages are an error: the model is held whole on each executor.
    """
    rows = df.select(df[id_col].cast("bigint").alias("doc_id"), df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    ids = bounded_sample(rows.select("doc_id", "lang"), "doc_id", sample, "lang")
    if (n := ids.select("lang").distinct().count()) > MOST_LANGS:
        raise ValueError(f"{n} languages to learn, at most {MOST_LANGS} are held")
    picked = rows.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    picked = stored(picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang"), "sample")

    def run(chunks):
        for batch, texts in chunks:
            langs, folds = batch.column(2).to_pylist(), [_fold(i) for i in batch.column(0).to_pylist()]
            for at in range(0, len(texts), _ROWS):
                counts = count_ngrams(texts.slice(at, _ROWS))
                used = [np.flatnonzero(r) for r in counts]
                yield {"lang": langs[at : at + _ROWS], "fold": folds[at : at + _ROWS], "ids": [u.astype(np.int32).tobytes() for u in used], "counts": [r[u].tobytes() for r, u in zip(counts, used, strict=True)]}

    found: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {}
    for r in bounded_rows(map_texts(picked, run, "lang string, fold int, ids binary, counts binary"), "ngrams"):
        found.setdefault(r.lang, []).append((np.frombuffer(r.ids, np.int32), np.frombuffer(r["counts"], np.float32), r.fold))
    langs = sorted(found)
    if not langs:
        return Model([], np.ones(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), np.zeros(0, np.int64), np.zeros(1), np.zeros(1))
    seen = np.zeros(1 << BITS)
    for rows_of in found.values():
        for ids_, _, _ in rows_of:
            seen[ids_] += 1
    idf = np.log((1 + sum(map(len, found.values()))) / (1 + seen)).astype(np.float32) + 1
    centres, owner, halves, half_of = [], [], [], []

    def whole_of(c: np.ndarray, grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(c), 1 << BITS), np.float32)
        out[:, grams] = c
        return out

    for i, lang in enumerate(langs):
        rows_of = sorted(found.pop(lang), key=lambda p: p[0].tobytes() + p[1].tobytes())
        grams = np.unique(np.concatenate([r[0] for r in rows_of]))  # the rest are zero in every text of the language
        x = np.zeros((len(rows_of), len(grams)), np.float32)
        for j, (ids_, counts, _) in enumerate(rows_of):
            x[j, np.searchsorted(grams, ids_)] = np.sqrt(counts) * idf[ids_]
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
        fold = np.array([f for _, _, f in rows_of])
        some = x.any(1)
        c = whole_of(_kmeans(x[some] if some.any() else x, centroids), grams)
        centres.append(c)
        owner += [i] * len(c)
        for f in (0, 1):  # what each half of the texts is measured against: centroids of the other half
            rest = some & (fold != f)
            halves.append(whole_of(_kmeans(x[rest], centroids), grams) if rest.any() else c)
            half_of += [2 * i + f] * len(halves[-1])
    model = Model(langs, idf, np.concatenate(centres), np.array(owner), np.zeros(1), np.zeros(1))
    sizes, own, other = _distances(picked, model, Model(langs * 2, idf, np.concatenate(halves), np.array(half_of), np.zeros(1), np.zeros(1)))
    model.sizes, model.reject = reject_limits(sizes, own, other if len(langs) > 1 else None)
    del found, rows_of, x, halves
    release_memory()
    return model


def _fold(doc: int | None) -> int:
    return crc32(str(doc).encode()) & 1


def _distances(picked: DataFrame, model: Model, halves: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sampled text and its parts that have n-grams: log2 of their number, the cosine to its own language's centroids
    that it was not learned from (``halves`` has two owners a language), and the cosine to all other languages."""
    held = picked.sparkSession.sparkContext.broadcast((model, halves))

    def run(chunks):
        model, halves = held.value
        of = {lang: i for i, lang in enumerate(model.langs)}

        def rows(texts, langs, folds):
            for at in range(0, len(texts), _ROWS):
                counts = count_ngrams(texts.slice(at, _ROWS))
                some = np.flatnonzero(counts.any(1))
                lang = np.array([of[x] for x in langs[at : at + _ROWS]])[some]
                best, half = model.cosines(counts[some]), halves.cosines(counts[some])
                own = half[np.arange(len(some)), 2 * lang + np.array(folds[at : at + _ROWS])[some]]
                best[np.arange(len(some)), lang] = -1
                yield {"size": np.log2((counts[some] > 0).sum(1)), "own": own, "other": best.max(1)}

        for batch, texts in chunks:
            langs, folds = batch.column(2).to_pylist(), [_fold(i) for i in batch.column(0).to_pylist()]
            yield from rows(texts, langs, folds)
            for at in range(0, len(texts), _ROWS):
                which, parts = _parts(texts.slice(at, _ROWS))
                yield from rows(parts, [langs[at + i] for i in which], [folds[at + i] for i in which])

    got = np.array([(r.size, r.own, r.other) for r in bounded_rows(map_texts(picked, run, "size double, own double, other double"), "distances")]).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def judge(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of a few texts."""
    counts = count_ngrams(texts)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    best = model.cosines(counts)
    lettered = np.array([has_letter(t.as_buffer().to_pybytes()) for t in texts], bool)
    pick = best.argmax(1)
    top = np.clip(best[np.arange(len(pick)), pick], 0, 1)
    langs = [model.langs[p] if ok else UNKNOWN for p, ok in zip(pick, lettered, strict=True)]
    return langs, np.where(lettered, top, 0.0), ~lettered | (top < model.limits(counts))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row.

    ``lang_pred`` is the nearest language, also of a rejected text; it is ``und`` with score 0, and rejected, for a
    null or empty text and one without a letter.  ``score`` is the cosine, 0 to 1.  Equal cosines give the first language
    in alphabetical order.  Repeated rows give equal rows; extra columns are not read; no rows give no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(chunks):
        for batch, texts in chunks:
            for at in range(0, len(texts), _ROWS):
                langs, score, rejected = judge(held.value, texts.slice(at, _ROWS))
                yield {"doc_id": batch.column(0).slice(at, _ROWS), "lang_pred": langs, "score": score, "rejected": rejected}

    return map_texts(slim(df, id_col, text_col), run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of ``df`` that are not rejected, with all their columns; batches are filtered in place, nothing is shuffled.

    If ``lang_col`` names a column of strings, it holds the identified language in the rows that stay.  Null and empty texts
    and those without a letter go; repeated rows stay or go alike; no rows give no rows.
    """
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    names, at = df.columns, df.columns.index(text_col)
    marked = df.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(len(names))])
            for rows, texts in text_batches([named], f"c{at}"):
                parts = [judge(held.value, texts.slice(i, _ROWS)) for i in range(0, len(texts), _ROWS)]
                columns = rows.columns
                if marked is not None:
                    columns[marked] = pa.array([x for langs, _, _ in parts for x in langs], columns[marked].type)
                keep = pa.array(np.concatenate([~rejected for _, _, rejected in parts]))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names)

    return df.mapInArrow(run, df.schema)
