"""Substring dedup: near-duplicate paragraphs by MinHash banding, removed by connected components.

Two kinds of paragraphs are compared.  Those of the layout are lines of LEAST words, and shorter lines in a row taken
together, whole whatever their length; one of over LONGEST words is also cut at content-defined words, and its parts are
compared beside it.  Windows are overlapping paragraphs of WINDOW words that do not heed line ends, for
passages that cross them or lie inside a longer line.  They begin at anchors: of every SPREAD consecutive shingles the
one with the least hash, so two texts that share WINDOW + SPREAD - 1 words in a row share a whole window.

Equal paragraphs (in lower case, by words) form classes.  Every paragraph has a MinHash of its word shingles, cut into bands:
``tune`` chooses bands and rows for a recall at the threshold.  Windows have one band: equal ones always meet in it, and
unequal ones of a Jaccard of s meet with probability s to the rows, in each of the windows that two passages share.
Classes that share a band are joined, verified by the exact Jaccard of their shingles, and linked; of every component of
links the first paragraph, by document and place, stays.

Windows that repeat and touch make one passage, which is grown word by word at both ends as far as it equals what its first
holder has there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import join_groups, map_texts, slim, small_batches, stored
from quarrion.llm.graph import components
from quarrion.llm.pairing import CHUNK_KEYS, candidate_edges, verified_edges

#: Words that a paragraph of the layout must have to count, words of one that is not cut as well, and of a cut part at least.
LEAST, LONGEST, PART = 30, 120, 40
SHINGLE, NUM, DEN = 5, 80, 100
RECALL, MOST_HASHES = 0.995, 128
#: Words of a window, shingles of which one is an anchor (50 words in a row always hold a window), rows of its band.
WINDOW, SPREAD, ROWS = 32, 19, 8
#: Windows of a bucket to aim at; a window has about WINDOW_BYTES bytes of text to itself.
BUCKET_WINDOWS, WINDOW_BYTES = 1 << 18, 60
_CUT = np.uint64(31)  # a word whose hash has these bits clear may begin a part


def tune(similarity: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs of this similarity with at least this probability.

    Rows as many as can be: with more rows of a band fewer unlike pairs collide.
    """
    for rows in range(12, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding within so many hashes reaches the recall")


def paragraphs(t: tv.Texts, i: int, words: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end word) of the paragraphs of text i, of LEAST words at least.

    Lines of fewer words are taken together up to the next longer line, or to a blank line once they have LEAST words.  A
    paragraph of over LONGEST words comes before its parts.
    """
    lo, hi = int(t.first[i]), int(t.first[i + 1])
    if hi - lo < LEAST:
        return []
    breaks = np.flatnonzero(t.data[t.offsets[i] : t.offsets[i + 1]] == 10) + t.offsets[i]
    edges = np.concatenate([[lo], np.searchsorted(t.starts[lo:hi], breaks) + lo, [hi]]).tolist()
    whole, since = [], lo  # since: the first of the short lines in a row
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= LEAST or (a == b and a - since >= LEAST):
            whole += [(since, a), (a, b)]
            since = b
    whole.append((since, hi))
    out = []
    for a, b in whole:
        if b - a >= LEAST:
            out.append((a, b))
        if b - a > LONGEST:
            marks = np.flatnonzero(words[a:b] & _CUT == 0) + a
            at = a
            while b - at > LONGEST:
                after = marks[np.searchsorted(marks, at + PART) :]
                to = int(after[0]) if len(after) and after[0] <= at + LONGEST else at + LONGEST
                out.append((at, to))
                at = to
            if b - at >= LEAST:
                out.append((at, b))
    return out


class Contents:
    """64-bit hashes of any runs of words of a chunk, two of them, by prefix sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = tv._power(len(words) + 1)
        self.sums = []
        for turn in (0, 1):
            s = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(tv.mix(words + tv.PLACE[8 + turn]) * up[: len(words)], out=s[1:])
            self.sums.append(s)

    def of(self, a: np.ndarray, b: np.ndarray, turn: int = 0) -> np.ndarray:
        s = self.sums[turn]
        return tv.mix((s[b] - s[a]) * self.down[a] + (b - a).astype(np.uint64)).view(np.int64)


def _layout(t: tv.Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, first and end word of the paragraphs of a chunk."""
    found = [(i, n, a, b) for i in range(len(t)) for n, (a, b) in enumerate(paragraphs(t, i, words))]
    return tuple(np.array([f[j] for f in found], np.int64) for j in range(4))


PARAGRAPHS = "doc_id bigint, paragraph int, start bigint, end bigint, n_words int, class bigint, mark bigint"


def _listed(chunks) -> Iterator[dict]:
    for batch, texts in chunks:
        t = tv.split(texts)
        words = tv.word_hashes(t)
        contents = Contents(words)
        i, n, a, b = _layout(t, words)
        if len(i):
            yield {"doc_id": batch.column(0).to_numpy()[i], "paragraph": n, "start": t.starts[a] - t.offsets[i], "end": t.ends[b - 1] - t.offsets[i], "n_words": b - a, "class": contents.of(a, b), "mark": contents.of(a, b, 1)}


_draw = np.random.default_rng(77)
_PLANES = _draw.integers(0, 1 << 31, MOST_HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1), _draw.integers(0, 1 << 32, MOST_HASHES, dtype=np.uint64).astype(np.uint32)
_ANCHOR = np.uint32(0x9E3779B1), np.uint32(0x7F4A7C15)


def minhash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(n, sets): the least of n hashes over sets that are ranges of 32-bit shingle hashes, each from ``at`` to the next."""
    low = np.empty((n, len(at)), np.uint32)
    for i in range(n):
        low[i] = np.minimum.reduceat(h * _PLANES[0][i] + _PLANES[1][i], at)
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(bands, sets): a 64-bit key for each band of MinHashes."""
    place = (np.arange(bands * rows, dtype=np.uint64) % np.uint64(rows) + np.uint64(1)) * tv.PLACE[1]
    sums = np.add.reduceat(tv.mix(low.astype(np.uint64) + place[:, None]), np.arange(0, bands * rows, rows), axis=0)
    return tv.mix(sums + (np.arange(bands, dtype=np.uint64) * tv.PLACE[2])[:, None])


def _flat(words: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the k-word shingles that begin at each word, wherever texts end."""
    return (tv.shingles(words, k) >> np.uint64(32)).astype(np.uint32)


def paragraph_signatures(k: int, bands: int, rows: int):
    """Band keys of the paragraphs of a chunk of texts, and their classes."""

    def run(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
        t = tv.split(texts)
        words = tv.word_hashes(t)
        _, _, a, b = _layout(t, words)
        if not len(a):
            return
        h, contents = _flat(words, k), Contents(words)
        n = np.maximum(b - a - k + 1, 1)
        at = np.append(0, np.cumsum(n))
        gathered = h[np.repeat(a - at[:-1], n) + np.arange(at[-1])]
        keys = band_keys(minhash(gathered, at[:-1], bands * rows), bands, rows)
        yield np.tile(contents.of(a, b), bands), keys.ravel(), None

    return run


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def windows(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(first words, band keys) of the windows of texts whose words begin at ``first`` (texts + 1), all texts at once."""
    n = np.diff(first)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not (n >= WINDOW).any():
        return none
    h = _flat(words, k)
    left = np.repeat(first[1:], n) - np.arange(len(words))  # words from each to its text's end
    starts = left >= WINDOW
    mark = np.zeros(len(words), np.uint32)
    mark[: len(h)] = h * _ANCHOR[0] + _ANCHOR[1]
    # the least of every SPREAD starts in a row, which never reach over two texts; the least of a text with fewer
    full = left >= WINDOW + SPREAD - 1
    least = _sliding(np.where(starts, mark, 0xFFFFFFFF).astype(np.uint32), min(SPREAD, len(words)), np.minimum)
    least = np.where(full[: len(least)], least, 0).astype(np.uint32)
    edge = np.zeros(SPREAD - 1, np.uint32)
    reach = _sliding(np.concatenate([edge, least, np.zeros(len(words) + SPREAD - 1 - len(least), np.uint32)]), SPREAD, np.maximum)[: len(words)]
    chosen = starts & (mark == reach)
    for i in np.flatnonzero((n >= WINDOW) & (n < WINDOW + SPREAD - 1)):
        own = slice(first[i], first[i + 1] - WINDOW + 1)
        chosen[own] = mark[own] == mark[own].min()
    at = np.flatnonzero(chosen)
    low = np.stack([_sliding(h * _PLANES[0][i] + _PLANES[1][i], WINDOW - k + 1, np.minimum)[at] for i in range(ROWS)])
    return at, band_keys(low, 1, ROWS)[0]


def _apart(at: np.ndarray, text: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which windows to keep: of equal ones of a text, those that do not overlap the one kept before."""
    keep = np.ones(len(at), bool)
    order = np.lexsort((at, content, text))
    same = (text[order][1:] == text[order][:-1]) & (content[order][1:] == content[order][:-1])
    last = 0
    for j in (np.flatnonzero(same) + 1).tolist():
        i, before = order[j], order[j - 1]
        if j < 2 or not same[j - 2]:
            last = at[before]
        if at[i] < last + WINDOW:
            keep[i] = False
        else:
            last = at[i]
    return keep


_PACKED = "bucket bigint, key binary, class binary, doc binary, word binary, start binary, bytes binary, known binary"
_MET = "class bigint, other bigint, doc_id bigint, word bigint, start bigint, end bigint"
_UNIT = np.dtype([("key", "<u8"), ("class", "<i8"), ("doc", "<i8"), ("word", "<u4"), ("start", "<u4"), ("bytes", "<u4"), ("known", "?")])


def _meet(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows by key, class and place; which of them share a key with one elsewhere; a star of the classes of such a key.

    Windows of a text that overlap are no repetition of each other.
    """
    u = u[np.lexsort((u["word"], u["doc"], u["class"], u["key"]))]
    new = np.append(True, u["key"][1:] != u["key"][:-1])
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    ends = lambda c: (np.minimum.reduceat(u[c], at), np.maximum.reduceat(u[c], at))
    (doc, last_doc), (word, last_word) = ends("doc"), ends("word")
    shared = (doc != last_doc) | (last_word - word.astype(np.int64) >= WINDOW) | np.maximum.reduceat(u["known"], at)
    least = u["class"][at][group]
    other = (least != u["class"]) & shared[group]
    edges = np.unique(np.stack([least[other], u["class"][other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return u, shared[group], edges


def _pack(u: np.ndarray, buckets: int) -> Iterator[dict]:
    """A row for each bucket with one window of each key and class; the others, known to be shared, and edges beside them."""
    u, shared, edges = _meet(u)
    u["known"] |= shared
    first = np.append(True, (u["key"][1:] != u["key"][:-1]) | (u["class"][1:] != u["class"][:-1]))
    heads, others = u[first], u[~first]
    bucket = ((heads["key"] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(heads))
    names = _UNIT.names
    rows = [(int(bucket[a]), *(heads[n][a:b].tobytes() for n in names)) for a, b in zip(at[:-1], at[1:], strict=True)]
    if len(others):
        rows.append((int(others["doc"][0]) % buckets, None, *(others[n].tobytes() for n in names[1:])))
    if len(edges):
        rows.append((int(edges[0, 0]) % buckets, edges[:, 0].tobytes(), edges[:, 1].tobytes(), *[None] * (len(names) - 2)))
    yield {n: [r[i] for r in rows] for i, n in enumerate(("bucket", *names))}


def _met(rows: pa.Table) -> pa.Table:
    """Members (windows that share a key) and edges between classes of a bucket."""
    heads, members, edges = [], [], []
    for r in rows.select(list(_UNIT.names)).to_pylist():
        if r["doc"] is None:
            edges.append(np.stack([np.frombuffer(r["key"], np.int64), np.frombuffer(r["class"], np.int64)], 1))
            continue
        u = np.zeros(len(r["doc"]) // 8, _UNIT)
        for n in _UNIT.names:
            if r[n] is not None:
                u[n] = np.frombuffer(r[n], _UNIT[n])
        (heads if r["key"] is not None else members).append(u)
    if heads:
        u, shared, own = _meet(np.concatenate(heads))
        members.append(u[shared])
        edges.append(own)
    u = np.concatenate(members) if members else np.zeros(0, _UNIT)
    e = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    whole = lambda a, b, gap: pa.array(np.concatenate([a, b]), pa.int64(), mask=np.concatenate(gap))
    none, no, yes = np.zeros(len(e), np.int64), np.zeros(len(u), bool), np.ones(len(e), bool)
    of = {n: u[n].astype(np.int64) for n in ("doc", "word", "start")} | {"end": u["start"].astype(np.int64) + u["bytes"]}
    return pa.table({"class": pa.array(np.concatenate([u["class"], e[:, 0]])), "other": whole(no.astype(np.int64), e[:, 1], [~no, ~yes])} | {n: whole(of[k], none, [no, yes]) for n, k in (("doc_id", "doc"), ("word", "word"), ("start", "start"), ("end", "end"))})


def shared_windows(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Windows that share a band with another, and edges between their classes (``other`` is not null)."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // WINDOW_BYTES // BUCKET_WINDOWS)

    def run(chunks):
        units, n = [], 0
        for batch, texts in chunks:
            t = tv.split(texts)
            words = tv.word_hashes(t)
            at, keys = windows(words, t.first, k)
            if not len(at):
                continue
            content = Contents(words).of(at, at + WINDOW)
            text = np.searchsorted(t.first, at, "right") - 1
            some = _apart(at, text, content)
            at, text = at[some], text[some]
            u = np.zeros(len(at), _UNIT)
            u["key"], u["class"], u["doc"], u["word"] = keys[some], content[some], batch.column(0).to_numpy()[text], at - t.first[text]
            u["start"] = t.starts[at] - t.offsets[text]
            u["bytes"] = t.ends[at + WINDOW - 1] - t.starts[at]
            units.append(u)
            n += len(at)
            if n >= CHUNK_KEYS // 2:
                yield from _pack(np.concatenate(units), buckets)
                units, n = [], 0
        if n:
            yield from _pack(np.concatenate(units), buckets)

    return stored(map_texts(docs, run, _PACKED).groupBy("bucket").applyInArrow(_met, _MET), "windows")


def _holders(members: DataFrame, total: int) -> DataFrame:
    """Windows whose content an earlier place has as well: their first holder, and whether they begin or end a run of such."""
    firsts = members.groupBy("class").agg(F.min(F.struct("doc_id", "word")).alias("x"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    found = join_groups(members.select("class", "doc_id", "word"), stored(firsts.select("class", F.col("x.doc_id").alias("keep_doc"), F.col("x.word").alias("keep_word"), "holders"), "firsts"), ["class"], "holders", total)
    found = found.where((F.col("keep_doc") < F.col("doc_id")) | ((F.col("keep_doc") == F.col("doc_id")) & (F.col("keep_word") + WINDOW <= F.col("word"))))
    order = Window.partitionBy("doc_id").orderBy("word")
    before = F.max(F.col("word") + WINDOW).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("word").over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumn("first", F.coalesce(before < F.col("word"), F.lit(True))).withColumn("last", F.coalesce(after > F.col("word") + WINDOW, F.lit(True)))
    return stored(marked.where("first or last").drop("holders").distinct(), "run_ends")


_AROUND = "class bigint, text string, doc_id bigint, word bigint, before binary, starts binary, after binary, ends binary"


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is asked of the documents, in one pass: the text of a class (start, end), or the words around a window (word).

    Each is checked against its class, so that documents which share an id do no harm.
    """
    asked = wanted.groupBy("doc_id").agg(F.to_json(F.collect_list(F.struct("class", "start", "end", "word"))).alias("asked"))
    rows = docs.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "asked")  # both grow with the data

    def run(chunks):
        import json

        for batch, texts in chunks:
            t = tv.split(texts)
            words = tv.word_hashes(t)
            contents = Contents(words)
            out = []
            for i, (doc, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lo, hi, base = int(t.first[i]), int(t.first[i + 1]), int(t.offsets[i])
                for q in json.loads(asked):
                    if "word" in q:
                        a = lo + q["word"]
                        b = a + WINDOW
                        if b > hi or contents.of(np.array([a]), np.array([b]))[0] != q["class"]:
                            continue
                        x, y = slice(max(lo, a - SPREAD + 1), a), slice(b, min(hi, b + SPREAD - 1))
                        out.append((None, None, doc, q["word"], words[x][::-1].tobytes(), (t.starts[x] - base)[::-1].tobytes(), words[y].tobytes(), (t.ends[y] - base).tobytes()))
                    else:
                        a, b = np.searchsorted(t.starts, base + q["start"]), np.searchsorted(t.ends, base + q["end"], "right")
                        if lo <= a < b <= hi and contents.of(np.array([a]), np.array([b]))[0] == q["class"]:
                            out.append((q["class"], t.data[t.starts[a] : t.ends[b - 1]].tobytes().decode("utf-8", "replace"), *[None] * 6))
            yield {n.split()[0]: [r[j] for r in out] for j, n in enumerate(_AROUND.split(", "))}

    return stored(map_texts(rows, run, _AROUND), "fetched")


def _grown(ends: DataFrame, around: DataFrame, total: int) -> DataFrame:
    """(doc_id, word, from, to, from_byte, to_byte) of windows at the ends of runs: how far they equal their first holder."""
    around = around.dropDuplicates(["doc_id", "word"])
    holders = ends.groupBy("keep_doc", "keep_word").agg(F.count(F.lit(1)).alias("n"))
    theirs = around.select(F.col("doc_id").alias("keep_doc"), F.col("word").alias("keep_word"), F.col("before").alias("their_before"), F.col("after").alias("their_after"))
    rows = join_groups(ends, theirs.join(holders, ["keep_doc", "keep_word"]), ["keep_doc", "keep_word"], "n", total).drop("n")
    rows = rows.join(around.select("doc_id", "word", "before", "starts", "after", "ends"), ["doc_id", "word"])
    rows = rows.select("doc_id", "word", "first", "last", "before", "starts", "after", "ends", "their_before", "their_after", (F.col("doc_id") == F.col("keep_doc")).alias("same"), (F.col("word") - F.col("keep_word") - WINDOW).alias("gap"))

    def same_words(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b)) // 8
        unlike = np.flatnonzero(np.frombuffer(a, np.int64, n) != np.frombuffer(b, np.int64, n))
        return int(unlike[0]) if len(unlike) else n

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left = same_words(r["before"], r["their_before"] or b"") if r["first"] else 0
                right = same_words(r["after"], r["their_after"] or b"") if r["last"] else 0
                left = min(left, r["gap"]) if r["same"] else left  # not into the holder itself
                out.append((r["doc_id"], r["word"], r["word"] - left, r["word"] + WINDOW + right, int(np.frombuffer(r["starts"], np.int64)[left - 1]) if left else None, int(np.frombuffer(r["ends"], np.int64)[right - 1]) if right else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(6)], names=["doc_id", "word", "from", "to", "from_byte", "to_byte"])

    small_batches(ends.sparkSession)
    return rows.mapInArrow(run, "doc_id bigint, word bigint, from bigint, to bigint, from_byte bigint, to_byte bigint").dropDuplicates(["doc_id", "word"])


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN, within: bool = False) -> DataFrame:
    """One row for each paragraph or passage that repeats an earlier one and would be removed.

    kind (``paragraph`` of the layout or ``passage`` of windows), doc_id, start and end (bytes of the text's UTF-8 form),
    n_words, keep_doc_id (the first document with it), for paragraphs their number among the document's
    paragraphs of LEAST words, and component_id: the class, a hash of the words, that names the component (for a passage,
    that of its first window).  What stays is the first of each component by document and place: keep_start, and
    keep_paragraph if it is one of the layout.  A document's repetition of itself counts only if ``within`` is set, and then if
    it does not overlap what stays; of what an earlier document holds every copy counts.  The two kinds may overlap, and
    so do a paragraph and its parts.

    Null, empty and short texts and rows with a null id give no rows; a row that repeats another (id and text) gives the same
    paragraphs again; no rows give no rows; other columns are not read.  Paragraphs of fewer than LEAST words are found only
    as part of lines taken together or of a window.
    """
    docs = slim(df, id_col, text_col).where("doc_id is not null")
    listed = stored(map_texts(docs, _listed, PARAGRAPHS), "paragraphs")
    bands, rows = tune(num / den)
    edges = stored(candidate_edges(docs, paragraph_signatures(k, bands, rows), listed.count() * bands), "pairs")
    met = shared_windows(docs, k)
    members = met.where("doc_id is not null").select("doc_id", "word", "start", "end", "class")
    place = lambda number, word: F.struct("doc_id", "start", "end", word.cast("bigint").alias("word"), number.cast("int").alias("paragraph")).alias("at")
    null = F.lit(None)
    units = listed.select("class", place(F.col("paragraph"), null), "n_words", "mark").unionByName(members.select("class", place(null, F.col("word")), F.lit(WINDOW).alias("n_words"), null.cast("bigint").alias("mark")))
    classes = units.groupBy("class").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"), F.max("n_words").alias("n_words"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    classes = stored(classes.where(F.coalesce(F.col("a") == F.col("b"), F.lit(True))).drop("a", "b"), "classes")  # unlike contents of one hash are left alone
    total = classes.agg(F.sum("size")).first()[0] or 0
    edges = edges.unionByName(_distant(met.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")).distinct(), classes))
    edges = stored(edges, "candidates")
    # the texts to verify and the words around the ends of runs, in one pass over the documents
    nodes = edges.select(F.col("a").alias("class")).unionByName(edges.select(F.col("b").alias("class"))).distinct()
    ends = _holders(members, total)
    asked = classes.join(nodes.hint("merge"), "class", "left_semi").select("first.doc_id", "class", "first.start", "first.end", null.cast("bigint").alias("word"))
    around = ends.select("doc_id", "class", "word").unionByName(ends.select(F.col("keep_doc").alias("doc_id"), "class", F.col("keep_word").alias("word"))).distinct()
    found = _fetched(docs, asked.unionByName(around.select("doc_id", "class", null.cast("bigint").alias("start"), null.cast("bigint").alias("end"), "word")))
    texts = found.where("class is not null").select(F.col("class").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    sizes = classes.select(F.col("class").alias("doc_id"), F.greatest(F.col("n_words") - k + 1, F.lit(1)).cast("bigint").alias("n"), (F.col("first.end") - F.col("first.start")).alias("bytes"))
    linked = components(verified_edges(texts, edges, sizes, k, num, den)).select(F.col("node").alias("class"), "component")
    # what stays of each component
    joined = stored(classes.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class")), "joined")
    heads = joined.groupBy("component").agg(F.min("first").alias("keep"), F.sum("size").alias("all"))
    groups = stored(joined.join(heads.where("all > 1"), "component").select("class", "size", "component", "keep", "first"), "repeated")
    repeats = (F.col("doc_id") != F.col("keep.doc_id")) | (F.lit(within) & (F.col("start") >= F.col("keep.end")))
    paragraph = join_groups(listed, groups, ["class"], "size", total).where(F.col("component").isNotNull() & repeats)
    paragraph = paragraph.select(F.lit("paragraph").alias("kind"), "doc_id", "paragraph", "start", "end", "n_words", "keep", "component")
    window = join_groups(members, groups, ["class"], "size", total).where(F.col("component").isNotNull() & repeats)
    passage = _passages(window, _grown(ends, found.where("class is null"), total))
    return paragraph.unionByName(passage.withColumn("paragraph", F.lit(None).cast("int"))).select("kind", "doc_id", "paragraph", "start", "end", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), F.col("keep.paragraph").alias("keep_paragraph"), F.col("component").alias("component_id"))


def _distant(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges of windows but for those that overlap in their first document, which say nothing of repetition."""
    of = lambda end: classes.select(F.col("class").alias(end), F.col("first").alias(f"first_{end}"))
    both = edges.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    x, y = (lambda f: F.col(f"first_a.{f}")), (lambda f: F.col(f"first_b.{f}"))
    overlap = (x("doc_id") == y("doc_id")) & (x("start") < y("end")) & (y("start") < x("end"))
    return both.where(~overlap).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _passages(window: DataFrame, grown: DataFrame) -> DataFrame:
    """Repeated windows, grown, joined where they touch; those that are only near another's bound no run that has equal ones."""
    window = window.join(grown.hint("merge"), ["doc_id", "word"], "left")
    or_own = lambda c, own: F.coalesce(F.col(c), own)
    exact = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("start") >= F.col("first.end"))
    window = window.select("doc_id", "word", "keep", "component", exact.alias("exact"), or_own("from", F.col("word")).alias("from"), or_own("to", F.col("word") + WINDOW).alias("to"), or_own("from_byte", F.col("start")).alias("start"), or_own("to_byte", F.col("end")).alias("end"))
    order = Window.partitionBy("doc_id").orderBy("from", "word")
    last = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = window.withColumn("new", F.coalesce(F.col("from") > last, F.lit(True)).cast("bigint")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bound = lambda pick, c: F.coalesce(pick(F.when(F.col("exact"), F.col(c))), pick(c))
    head: Column = F.min(F.struct(~F.col("exact"), "word", "component")).alias("head")
    runs = runs.groupBy("doc_id", "run").agg(bound(F.min, "start").alias("start"), bound(F.max, "end").alias("end"), (bound(F.max, "to") - bound(F.min, "from")).cast("int").alias("n_words"), F.min("keep").alias("keep"), head)
    return runs.select(F.lit("passage").alias("kind"), "doc_id", "start", "end", "n_words", "keep", F.col("head.component").alias("component"))


def remove_passages(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the removed byte ranges cut out of each text.

    Rows that share an id lose the same ranges, so ids should be unique.  A null text stays null, rows without a range and
    rows with a null id stay as they are, ranges may overlap; no rows give no rows.
    """
    spans = removed.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = slim(df, id_col, text_col).join(spans, "doc_id", "left")
    cut = rows.select("doc_id", "text", F.to_json("spans").alias("spans"))

    def run(chunks):
        import json

        for batch, texts in chunks:
            out = []
            for was, text, spans in zip(batch.column(1), texts.to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = text.encode()
                until = len(b)  # spans may overlap
                for s in sorted(json.loads(spans) if spans else [], key=lambda s: -s["end"]):
                    b = b[: s["start"]] + b[min(s["end"], until) :] if s["start"] < until else b
                    until = min(until, s["start"])
                out.append(b.decode("utf-8", "replace") if was.is_valid else None)
            yield {"doc_id": batch.column(0), "text": out}

    return map_texts(cut, run, "doc_id bigint, text string")
