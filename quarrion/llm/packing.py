"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Lengths are integers up to the sequence length, so the histogram of piece lengths, which is all that best-fit
decreasing depends on, has a bounded size however many documents there are.  The driver packs that histogram: lengths
in falling order, each into the tightest open bin, which a segment tree over remaining capacities finds in logarithmic
time.  Bins with equal capacities are handled as ranges and equal pieces as runs, so the plan stays small; executors
then give every piece its place from its rank among the pieces of its length.  The result is exactly that of
best-fit decreasing over all pieces at once, with no packing group whose last bins stay half empty.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm.common import bounded_rows, map_texts, slim, stored

END = 0  # the id that follows each document
#: Pieces of one rank group; more pieces make more groups.
RANKED = 100_000


@cache
def encoder(path: str):
    """A fast encoder with the vocabulary, merges and added tokens of a byte-level BPE ``tokenizers`` file; its ids are the same.

    In such a file the merges are numbered in their order, after the single bytes, so ids serve as merge ranks.
    """
    import tiktoken

    file = json.load(open(path, encoding="utf-8"))
    model, added = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t[flag] for t in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")) or any(a != b and a in b for a in added for b in added):
        raise ValueError(f"{path}: added tokens that take in their surroundings or hold each other are not supported")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merged = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if len(token) == 1 or token in merged}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level pre-tokenizer's
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def token_ids(path: str, text: str) -> np.ndarray:
    """A document's ids with the closing id; an added token's string has its one id, as ``tokenizers`` gives by default."""
    return np.append(encoder(path).encode_to_numpy(text, allowed_special="all"), END).astype("<u4")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``most`` ids but the first, which may be shorter."""
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


class CapacityTree:
    """A segment tree over capacities 0..most that says which have open bins."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` with an open bin."""
        i = length + self.size
        if self.any[i]:
            return length
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


@dataclass
class Run:
    """Pieces of ranks [lo, hi) of a length go to bins from ``bin`` on, ``per`` to a bin, the first at ``offset``."""

    length: int
    lo: int
    hi: int
    bin: int
    per: int
    offset: int


def best_fit(histogram: dict[int, int], most: int) -> tuple[list[Run], int]:
    """Best-fit decreasing over (length: count); the placements and the number of bins."""
    tree, open_bins, runs, bins = CapacityTree(most), {}, [], 0

    def release(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            if not open_bins.get(capacity):
                tree.mark(capacity, True)
            open_bins.setdefault(capacity, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]
        while done < count:
            capacity = tree.tightest(length)
            if capacity is None:
                per = most // length
                n = -(-(count - done) // per)
                first, capacity, bins = bins, most, bins + n
            else:
                first, n = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.mark(capacity, False)
                per = capacity // length
            full, rest = min(n, (count - done) // per), 0
            if full < n:
                rest = count - done - full * per
            placed = full * per + rest
            runs.append(Run(length, done, done + placed, first, per, most - capacity))
            release(capacity - per * length, first, full)
            used = full
            if rest:
                release(capacity - rest * length, first + full, 1)
                used += 1
            release(capacity, first + used, n - used)
            done += placed
    return runs, bins


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(df: DataFrame, path: str, most: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of every row (null text: empty, the closing id alone); ``ids`` too if asked for."""

    def run(chunks):
        for batch, texts in chunks:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
                ids = token_ids(path, text)
                for i, (s, n) in enumerate(cut(len(ids), most)):
                    part = ids[s : s + n]
                    rows.append((doc, i, s, n, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_texts(slim(df, id_col, text_col), run, PIECES + ", ids array<bigint>" * with_ids)


def pack(df: DataFrame, path: str, most: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    Every row of ``df`` is packed, repeated rows and null ids too; a null or empty text is its closing id alone; a
    document of over ``most`` ids is cut.  Ties (equal lengths) go by id and piece.  An empty table gives no rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    rows = stored(pieces(df, path, most, id_col, text_col, with_ids), "pieces")
    total = rows.count()
    salts = max(1, total // RANKED)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = stored(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r.length: r.n for r in bounded_rows(counts.groupBy("length").agg(F.sum("_n").alias("n")), "histogram")}  # at most ``most`` rows
    runs, _ = best_fit(histogram, most)
    by_length: dict[int, list[tuple]] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append((r.lo, r.hi, r.bin, r.per, r.offset))
    plan = spark.createDataFrame(list(by_length.items()), "_length bigint, _runs array<struct<lo:bigint,hi:bigint,bin:bigint,per:bigint,offset:bigint>>")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # the plan has a row for each length: at most ``most`` rows
    placed = ranked.join(F.broadcast(plan), F.col("length") == F.col("_length"))
    placed = placed.withColumn("_run", F.element_at(F.filter("_runs", lambda r: (F.col("_rank") >= r["lo"]) & (F.col("_rank") < r["hi"])), 1))
    at = F.col("_rank") - F.col("_run.lo")
    return placed.select(
        *rows.columns, (F.col("_run.bin") + F.floor(at / F.col("_run.per"))).cast("bigint").alias("sequence_id"),
        (F.col("_run.offset") + (at % F.col("_run.per")) * F.col("length")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids, assembled: sequence_id, ids, and the (doc_id, piece, offset, length) spans in order.

    Null ids and repeated rows are pieces like others; no pieces give no rows.
    """
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.transform("_p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("spans"))
