"""Line dedup by pairwise alignment.

Documents overlap if they share a block: a run of lines with BLOCK_WORDS words.  The index holds a hash of every shortest
such run, a long line alone and short or blank lines together, and pairs each document with the first holder (the least
id) of each of its runs.  So a run in n documents gives n - 1 pairs however common it is: a rare one finds its few holders,
and a common one needs no cap.

Each pair is aligned by patience diff: lines that occur once in both documents anchor the alignment, in the longest increasing
order, and the gaps between anchors are aligned the same way.  Runs of aligned lines that hold enough words are deleted from
the later document.  Patience diff leaves out blocks that stand in another order, and gaps without a line of their own; what
the pair still shares there is aligned as moved blocks, by the runs of both.  So no block that any earlier document holds
stays, and none goes that no earlier document holds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import arrow_schema, join_groups, map_texts, slim, small_batches, stored

#: Words of an aligned block to delete at least.
BLOCK_WORDS = 8
#: Pairs with one earlier document that a task gets to align at most, about.
SHARE = 5000


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) whose second members increase: patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[i] = pile[at - 1] if at else -1
        if at == len(tops):
            tops.append(y)
            pile.append(i)
        else:
            tops[at], pile[at] = y, i
    out = []
    i = pile[-1] if pile else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both, with a[i] == b[j]."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place])
        if not anchors:
            continue
        out += anchors
        for (i, j), (x, y) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if x - i > 1 and y - j > 1:
                todo.append((i + 1, x, j + 1, y))
    return sorted(out)


def common_blocks(matches: list[tuple[int, int]], words: Sequence[int], least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """(first line, lines) in the later document of the runs of aligned lines with at least so many words."""
    out, start = [], 0
    for n in range(1, len(matches) + 1):
        if n == len(matches) or matches[n] != (matches[n - 1][0] + 1, matches[n - 1][1] + 1):
            first, last = matches[start][1], matches[n - 1][1]
            if sum(words[first : last + 1]) >= least:
                out.append((first, last - first + 1))
            start = n
    return out


LINES = "doc_id bigint, lines array<bigint>, words array<bigint>"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line hashes, words of each line); lines are compared by their words with A-Z in lower case."""

    def run(chunks):
        for batch, texts in chunks:
            t = tv.split(texts)
            words = tv.word_hashes(t)
            breaks = np.flatnonzero(t.data == 10)
            hashes, sizes = [], []
            for i in range(len(t)):
                lo, hi = int(t.first[i]), int(t.first[i + 1])
                own = breaks[np.searchsorted(breaks, t.offsets[i]) : np.searchsorted(breaks, t.offsets[i + 1])]
                edges = np.concatenate([[lo], np.searchsorted(t.starts[lo:hi], own) + lo, [hi]])
                n = np.diff(edges)
                place = np.arange(hi - lo) - np.repeat(edges[:-1] - lo, n)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(words[lo:hi] + place.astype(np.uint64) * tv.PLACE[5]))])
                hashes.append(tv.mix(sums[edges[1:] - lo] - sums[edges[:-1] - lo] + n.astype(np.uint64)).view(np.int64))
                sizes.append(n)
            yield {"doc_id": batch.column(0), "lines": hashes, "words": sizes}

    return map_texts(docs, run, LINES)


def shortest_runs(lines: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, hash) of the runs of at least so many words that are shortest for their first or for their last line.

    Every line of a longer run lies in one of these within it.
    """
    n = len(lines)
    sums = np.concatenate([[0], np.cumsum(words)])
    start, end = np.arange(n), np.arange(1, n + 1)
    to = np.searchsorted(sums, sums[:-1] + least)  # the first end that reaches the words
    of = np.searchsorted(sums, sums[1:] - least, "right") - 1  # the last start that does
    a = np.concatenate([start[to <= n], of[of >= 0]])
    b = np.concatenate([to[to <= n], end[of >= 0]])
    a, b = np.unique(np.stack([a, b], 1), axis=0).T if len(a) else (a, b)
    up, down = tv._power(n + 1)
    whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(lines.view(np.uint64)) * up[:n])])
    return a, b - a, tv.mix((whole[b] - whole[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)


def moved_blocks(lines: np.ndarray, words: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which lines lie in a run whose hash is among ``held`` (sorted)."""
    first, n, run = shortest_runs(lines, words)
    at = np.searchsorted(held, run)
    hit = held[np.minimum(at, len(held) - 1)] == run if len(held) else np.zeros(len(run), bool)
    edge = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edge, first[hit], 1)
    np.add.at(edge, (first + n)[hit], -1)
    return np.cumsum(edge)[:-1] > 0


def aligned(before: np.ndarray, held: np.ndarray, lines: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of the lines of a later document in blocks that align with an earlier one, whose lines and runs are given."""
    gone = moved_blocks(lines, words, held)
    for at, n in common_blocks(patience(before.tolist(), lines.tolist()), words.tolist()):
        gone[at : at + n] = True
    return np.flatnonzero(gone)


def pairs_of(known: DataFrame) -> DataFrame:
    """Distinct (earlier, doc_id): each document with the first holders of its runs; ``known`` has a row for each id."""
    small_batches(known.sparkSession)

    def find(batches):
        for batch in batches:
            docs, runs = [], []
            for i in range(batch.num_rows):
                run = np.unique(shortest_runs(*(np.array(batch.column(c)[i].values, np.int64) for c in (1, 2)))[2])
                runs.append(run)
                docs.append(np.full(len(run), batch.column(0)[i].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(runs))], names=["doc_id", "run"])

    held = stored(known.select("doc_id", "lines", "words").mapInArrow(find, "doc_id bigint, run bigint"), "runs")
    shared = held.groupBy("run").agg(F.min("doc_id").alias("earlier"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    found = join_groups(held, stored(shared, "shared"), ["run"], "holders", held.count())
    return stored(found.where(F.col("earlier") < F.col("doc_id")).select("earlier", "doc_id").distinct(), "pairs")


def aligned_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending), n_partners.

    A line is removed if it lies in a block of BLOCK_WORDS words that aligns with a document of a smaller id; ``n_partners``
    counts the documents with which it was aligned.  Lines are compared by their words with A-Z in lower case and are
    cut at line feeds; a null or empty text has one empty line.  Rows with a null id, and equal ids beside the first, take no
    part in pairs beyond their id: rows that share an id are aligned as the first of them by content and are reported alike.
    No rows give no rows; other columns are not read.
    """
    docs = slim(df, id_col, text_col)
    table = stored(line_table(docs), "lines")
    known = stored(table.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("lines", "words")).alias("x")).select("doc_id", "x.*"), "documents")
    pairs = pairs_of(known)
    # an earlier document of many pairs is given to several tasks; only ids and counts are broadcast
    counts = pairs.groupBy("earlier").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / SHARE).cast("bigint"))
    counts = stored(counts, "partners")
    dealt = join_groups(pairs, counts, ["earlier"], "n", pairs.count()).withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")))
    first = known.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("before"), F.col("words").alias("words_before")).join(counts.hint("merge"), "earlier")
    first = first.select("earlier", "before", "words_before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"))
    later = dealt.select("earlier", "share", "doc_id").join(known.hint("merge"), "doc_id")
    both = later.join(first.hint("merge"), ["earlier", "share"]).select("doc_id", "lines", "words", "before", "words_before", "earlier")
    schema = "doc_id bigint, removed array<bigint>"

    def align(batches):
        to = arrow_schema(schema)
        last, held = None, np.zeros(0, np.int64)
        for batch in batches:
            removed = []
            for i in range(batch.num_rows):
                lines, words, before, words_before = (np.array(batch.column(c)[i].values, np.int64) for c in (1, 2, 3, 4))
                if (earlier := batch.column(5)[i].as_py()) != last:  # rows come in order of the earlier document
                    last, held = earlier, np.unique(shortest_runs(before, words_before)[2])
                removed.append(aligned(before, held, lines, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.list_(pa.int64()))], schema=to)

    small_batches(df.sparkSession)
    gone = both.mapInArrow(align, schema).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"), F.count(F.lit(1)).alias("n_partners"))
    out = table.select("doc_id", F.size("lines").cast("bigint").alias("n_lines")).join(gone, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    removed = F.coalesce("removed", none)
    return out.select("doc_id", "n_lines", F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"), F.coalesce("n_partners", F.lit(0).cast("bigint")).alias("n_partners"))


def delete_lines(df: DataFrame, aligned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) without the removed lines; a null text stays null, rows with a null id stay as they are.

    Rows that share an id lose the same lines, so ids should be unique; no rows give no rows.
    """
    gone = aligned.where("n_removed > 0").select("doc_id", "removed")
    rows = slim(df, id_col, text_col).join(gone, "doc_id", "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("removed", i.cast("bigint")), x)), lambda x: x.isNotNull())
    return rows.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
