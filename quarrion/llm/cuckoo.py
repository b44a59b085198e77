"""Exact dedup by a cuckoo-filter index over content digests.

``CuckooFilter`` holds 16-bit fingerprints in two candidate buckets of four slots and supports insertion and
deletion.  ``DigestIndex`` puts a bucketed content store behind it: a filter miss is a new digest without a look at
the store; a hit is verified against the stored full digest in its content bucket; an insertion that overflows the
filter doubles it and refills it from the stored keys.

``exact_dedup`` runs one index for each input partition, so that a group of copies leaves one partial row for each
partition however large the group is, and one index for each hash bucket of the partial rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm.common import free_name, join_groups, small_batches, stored

SLOTS, KICKS, MASK64 = 4, 200, (1 << 64) - 1


class Overflow(Exception):
    pass


class CuckooFilter:
    """Partial-key cuckoo hashing over 64-bit keys: false positives are possible, false negatives are not."""

    def __init__(self, buckets: int = 1 << 10):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.mask = buckets - 1
        self.table = [0] * (buckets * SLOTS)  # 0: free
        self.size = 0
        self._turn = 0

    @staticmethod
    def _print(key: int) -> int:
        return (key >> 48) % 65535 + 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ fingerprint * 0x5BD1E995) & self.mask

    def _places(self, key: int) -> tuple[int, int, int]:
        f = self._print(key)
        b = key & self.mask
        return f, b, self._other(b, f)

    def _put(self, bucket: int, f: int) -> bool:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if not self.table[i]:
                self.table[i] = f
                return True
        return False

    def contains(self, key: int) -> bool:
        f, a, b = self._places(key)
        t = self.table
        return f in t[a * SLOTS : a * SLOTS + SLOTS] or f in t[b * SLOTS : b * SLOTS + SLOTS]

    def insert(self, key: int) -> None:
        """Overflow leaves every earlier key in the filter but one; the owner must rebuild from its keys."""
        f, a, b = self._places(key)
        if not (self._put(a, f) or self._put(b, f)):
            at = b
            for _ in range(KICKS):
                self._turn = self._turn * 5 + 3 & 0xFFFF  # a fixed sequence, so that a task run again does the same
                i = at * SLOTS + self._turn % SLOTS
                f, self.table[i] = self.table[i], f
                at = self._other(at, f)
                if self._put(at, f):
                    break
            else:
                raise Overflow
        self.size += 1

    def delete(self, key: int) -> bool:
        """Only for keys that were inserted."""
        f, a, b = self._places(key)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[i] == f:
                    self.table[i] = 0
                    self.size -= 1
                    return True
        return False


class DigestIndex:
    """Live digests with a value each, behind a cuckoo filter."""

    def __init__(self, buckets: int = 1 << 10):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, dict[bytes, tuple]] = {}  # content bucket (64-bit key) -> full digest -> value
        self.resizes = self.misses = self.false_hits = 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def get(self, digest: bytes) -> tuple | None:
        key = self.key(digest)
        if not self.filter.contains(key):
            self.misses += 1
            return None
        value = self.content.get(key, {}).get(digest)
        self.false_hits += value is None
        return value

    def put(self, digest: bytes, value: tuple) -> None:
        """Add a digest or replace its value; the store is looked at only if the filter says that the key may be there."""
        key = self.key(digest)
        if self.filter.contains(key) and (bucket := self.content.get(key)) is not None:
            bucket[digest] = value
        else:
            self.add(digest, value)

    def add(self, digest: bytes, value: tuple) -> None:
        """Add a digest whose key the filter does not hold, without a look at the store."""
        key = self.key(digest)
        self.content[key] = {digest: value}
        self._index(key)

    def evict(self, n: int) -> list[tuple[bytes, tuple]]:
        """Take out the n digests that were added first."""
        out = []
        for digest, value in islice(self.items(), n):
            out.append((digest, value))
        for digest, _ in out:
            self.remove(digest)
        return out

    def remove(self, digest: bytes) -> bool:
        """A deleted digest is no longer live: the next text with it counts as new."""
        key = self.key(digest)
        bucket = self.content.get(key, {})
        if digest not in bucket:
            return False
        del bucket[digest]
        if not bucket:
            del self.content[key]
            self.filter.delete(key)
        return True

    def _index(self, key: int) -> None:
        try:
            self.filter.insert(key)
        except Overflow:
            buckets = (self.filter.mask + 1) * 2
            while True:
                self.resizes += 1
                self.filter = CuckooFilter(buckets)
                try:
                    for k in self.content:
                        self.filter.insert(k)
                    return
                except Overflow:
                    buckets *= 2

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for bucket in self.content.values():
            yield from bucket.items()


#: Live digests of a map-side index: beyond, the older half is given on and deleted.  A bound on memory only, as partial
#: rows of one digest meet again after the shuffle.  And rows of a merging task to aim at.
MAP_DIGESTS, TASK_ROWS = 250_000, 500_000


def _merge(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    index, live = DigestIndex(), 0

    def out(rows: list[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["digest", "keep_id", "group_size"])

    for batch in batches:
        for digest, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = index.get(digest)
            if found is None:
                index.put(digest, (doc, n))
                live += 1
            else:
                kept = found[0] if doc is None else doc if found[0] is None else max(found[0], doc)
                index.put(digest, (kept, found[1] + n))
        if limit and live > limit:
            yield from out(index.evict(live - limit // 2))
            live = limit // 2
    yield from out(list(index.items()))


def merge_digests(rows: DataFrame, total: int) -> DataFrame:
    """(digest, keep_id, group_size) of ``total`` rows with these columns: the largest id and the total size of each digest.

    A merging task gets about TASK_ROWS rows at most, however many there are.
    """
    schema = "digest binary, keep_id bigint, group_size bigint"
    small_batches(rows.sparkSession)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS + 1)
    partial = rows.select("digest", "keep_id", "group_size").mapInArrow(lambda b: _merge(b, MAP_DIGESTS), schema)
    return partial.repartition(tasks, "digest").mapInArrow(lambda b: _merge(b, None), schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms (``normalise``, the text itself by default) are identical; a null text
    counts as empty.  The row with the largest id stays; a null id stays only in a group without another id, and of
    rows that repeat the kept id all are marked kept.  An empty table gives an empty result.  Other columns are not
    read.  Digests, not texts, are shuffled.
    """
    text = F.coalesce(df[text_col].cast("string") if normalise is None else normalise, F.lit(""))
    digests = stored(df.select(df[id_col].cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    total = digests.count()
    groups = stored(merge_digests(digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")), total), "groups")
    # copies of a text get the group's row; the rest are groups of one and need no join
    found = join_groups(digests, groups.where("group_size > 1"), ["digest"], "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(keep), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None) -> DataFrame:
    """The rows of ``df`` whose text stays, with all their columns: exactly one row of each text.

    Ids need not be unique: a row goes by its id and its text together.  Of rows that repeat both, the one with the least
    other columns stays, and so does one row of a text that only has null ids.  A null text counts as empty.  No rows give
    no rows.
    """
    names = [free_name(df.columns, n) for n in ("_id", "_sha256")]
    text = F.coalesce(df[text_col].cast("string") if normalise is None else normalise, F.lit(""))
    rows = df.withColumns({names[0]: df[id_col].cast("bigint"), names[1]: F.unhex(F.sha2(text, 256))})
    found = exact_dedup(df, id_col, text_col, normalise).where("group_size > 1")
    found = stored(found.select("kept", F.col("doc_id").alias(names[0] + "d"), F.unhex("text_sha256").alias(names[1] + "d")), "copies")
    same = lambda other: rows[names[0]].eqNullSafe(other[names[0] + "d"]) & (rows[names[1]] == other[names[1] + "d"])
    gone = found.where("not kept").select(names[0] + "d", names[1] + "d").distinct()
    again = found.where("kept").groupBy(names[0] + "d", names[1] + "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone, again = (x.hint("merge") for x in (gone, stored(again, "repeated")))  # ids grow with the data: never broadcast
    if again.isEmpty():
        return rows.join(gone, same(gone), "left_anti").select(*df.columns)
    both = gone.unionByName(again)
    pick = F.any_value if any("map<" in kind or kind == "variant" for _, kind in df.dtypes) else F.min  # maps have no order
    one = rows.join(again, same(again), "left_semi").groupBy(*names).agg(pick(F.struct(*(df[c] for c in df.columns))).alias(names[0] + "r"))
    return rows.join(both, same(both), "left_anti").select(*df.columns).unionByName(one.select(f"{names[0]}r.*"))
