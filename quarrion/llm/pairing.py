"""From signatures to verified links: shared by the near-duplicate operators.

``candidate_edges`` turns the signature keys of items into candidate edges, a spanning star for each key, so a key with
n items gives n - 1 edges.  Keys travel packed: a map task sorts its keys, keeps one item of each key, links the others to
it at once, and writes one compact row for each bucket of the key space.  Whatever share of all items one key has,
a bucket sees it at most once for each chunk of a map task.

``verified_edges`` takes the components of the candidate edges as groups and verifies exactly within them.  Small groups
share tasks; a large one is cut into blocks, and each pair of blocks is a task, so no task holds a whole large group.
Within a task, pairs that already hang together are skipped, and a lower bound of the symmetric difference from
128-bin histograms rules out pairs before sets are intersected: both lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import join_groups, map_texts, small_batches, stored
from quarrion.llm.graph import components

#: Keys that a map task packs at once, and keys of a bucket to aim at.
CHUNK_KEYS, BUCKET_KEYS = 1 << 20, 1 << 20
#: Items, shingles and bytes of text of a block, and shingles and bytes of a task that holds small groups.
BLOCK_ITEMS, BLOCK_SHINGLES, BLOCK_BYTES = 2000, 1_000_000, 32 << 20
TASK_SHINGLES, TASK_BYTES = 400_000, 16 << 20
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _star(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys' first positions, and (least item, other item) for every further item of a key."""
    order = np.lexsort((items, keys))
    keys, items = keys[order], items[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    least = np.repeat(items[at], np.diff(np.append(at, len(keys))))
    other = least != items
    pairs = np.unique(np.stack([least[other], items[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return order[at], pairs[:, 0], pairs[:, 1]


def _pack(keys: np.ndarray, items: np.ndarray, buckets: int) -> Iterator[dict]:
    if not len(keys):
        return
    first, a, b = _star(keys, items)
    keys, items = keys[first], items[first]  # now in key order
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys))
    rows = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        known, local = np.unique(items[lo:hi], return_inverse=True)
        k = keys[lo:hi]
        rows.append((int(bucket[lo]), k.astype("<u4").tobytes(), (k >> np.uint64(32)).astype(np.uint8).tobytes(), known.tobytes(), local.astype("<u2" if len(known) < 1 << 16 else "<u4").tobytes(), None, None))
    if len(a):
        rows.append((int(a[0]) % buckets, None, None, None, None, a.tobytes(), b.tobytes()))
    yield {n: [r[i] for r in rows] for i, n in enumerate(("bucket", "low", "high", "known", "local", "a", "b"))}


def _unpack(rows: pa.Table) -> pa.Table:
    keys, items, a, b = [], [], [], []
    for row in rows.select(["low", "high", "known", "local", "a", "b"]).to_pylist():
        if row["a"] is not None:
            a.append(np.frombuffer(row["a"], np.int64))
            b.append(np.frombuffer(row["b"], np.int64))
            continue
        high = np.frombuffer(row["high"], np.uint8)
        keys.append(np.frombuffer(row["low"], "<u4").astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
        local = np.frombuffer(row["local"], "<u2" if len(row["local"]) == 2 * len(high) else "<u4")
        items.append(np.frombuffer(row["known"], np.int64)[local])
    if keys:
        _, x, y = _star(np.concatenate(keys), np.concatenate(items))
        a.append(x)
        b.append(y)
    out = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
    return pa.Table.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], schema=_EDGES)


def candidate_edges(docs: DataFrame, signatures: Callable[[np.ndarray, pa.Array], Iterator[tuple[int | np.ndarray, np.ndarray, int | None]]], expected: int) -> DataFrame:
    """Distinct (a, b) with a < b: a star of candidate edges for each signature key.

    ``docs`` has ``doc_id`` (not null) and ``text``; ``signatures`` gets the ids and texts of a chunk and yields (item or
    items, keys, content hash).  Within a chunk of keys, items of equal content hash (unless it is None) are emitted once.
    ``expected``, the number of keys, sizes the buckets.
    """
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, expected // BUCKET_KEYS + 1)

    def run(chunks):
        keys, ids, n, seen = [], [], 0, set()
        for batch, texts in chunks:
            for item, k, content in signatures(batch.column(0).to_numpy(), texts):
                if content is not None:
                    if content in seen:
                        continue
                    seen.add(content)
                keys.append(k)
                ids.append(np.full(len(k), item, np.int64))
                n += len(k)
                if n >= CHUNK_KEYS:
                    yield from _pack(np.concatenate(keys), np.concatenate(ids), buckets)
                    keys, ids, n, seen = [], [], 0, set()
        if n:
            yield from _pack(np.concatenate(keys), np.concatenate(ids), buckets)

    packed = map_texts(docs, run, "bucket bigint, low binary, high binary, known binary, local binary, a binary, b binary")
    return packed.groupBy("bucket").applyInArrow(_unpack, "a bigint, b bigint").distinct()


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        at = x
        while self.up.get(at, at) != at:
            at = self.up[at]
        while self.up.get(x, x) != at:
            self.up[x], x = at, self.up[x]
        return at

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def link_sets(nodes: list[int], sets: list[np.ndarray], left: np.ndarray, num: int, den: int, union: _Union, cross: bool) -> None:
    """Join every two nodes whose sets reach the Jaccard num / den; of blocks ``left`` and not, across only if asked for."""
    if len(nodes) == 2:
        a, b = sets
        if nodes[0] != nodes[1] and len(a) and len(b) and min(len(a), len(b)) * den >= max(len(a), len(b)) * num and (not cross or left[0] != left[1]):
            both = tv.shared_count(a, b)
            if den * both >= num * (len(a) + len(b) - both):
                union.join(*nodes)
        return
    order = np.lexsort((np.array(nodes), np.array([len(s) for s in sets])))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    side = left[order]
    bins = np.zeros((len(order), 128), np.int32)
    for r, i in enumerate(order):
        bins[r] = np.bincount((sets[i] >> np.uint64(57)).astype(np.int64), minlength=128)
    for r, i in enumerate(order):
        if not sizes[r]:
            continue
        to = int(np.searchsorted(sizes, sizes[r] * den // num, "right"))
        if to <= r + 1:
            continue
        gap = np.abs(bins[r + 1 : to] - bins[r]).sum(1)
        ok = gap * (den + num) <= (sizes[r] + sizes[r + 1 : to]) * (den - num)
        if cross:
            ok &= side[r + 1 : to] != side[r]
        at = np.flatnonzero(ok)
        for c in at[np.argsort(gap[at], kind="stable")]:
            j = order[r + 1 + c]
            if union.find(nodes[i]) == union.find(nodes[j]):
                continue
            both = tv.shared_count(sets[i], sets[j])
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                union.join(nodes[i], nodes[j])


def verified_edges(texts: DataFrame, edges: DataFrame, sizes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): edges that connect exactly the items whose k-word shingle sets link, within components of ``edges``.

    ``texts`` has doc_id and text; ``sizes`` has doc_id, n (the number of distinct shingles of each item) and bytes of text.
    """
    groups = stored(components(edges).join(sizes.select(F.col("doc_id").alias("node"), "n", "bytes"), "node"), "candidates")
    load = groups.groupBy("component").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c"), F.sum("bytes").alias("_b"))
    load = load.select("component", "_c", F.greatest(*(F.ceil(F.col(c) / most) for c, most in (("_n", BLOCK_SHINGLES), ("_c", BLOCK_ITEMS), ("_b", BLOCK_BYTES)))).cast("bigint").alias("blocks"))
    total = groups.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("c")).first()
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total.n or 0) // TASK_SHINGLES, int(total.bytes or 0) // TASK_BYTES)
    placed = join_groups(groups, load, ["component"], "_c", total.c).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")))
    placed = placed.select("node", "component", F.col("own").alias("own"), "other", task.alias("task"))
    # candidates grow with the data, so neither side is ever broadcast
    wanted = texts.join(placed.hint("merge"), texts["doc_id"] == placed["node"]).select("task", "component", "own", "other", "node", "text")

    def verify(rows: pa.Table) -> pa.Table:
        union = _Union()
        column = rows.column("text").cast(pa.large_string()).fill_null("")  # together they may be over 2 GB
        sets: list[np.ndarray] = []
        for piece in column.chunks:
            sets += tv.shingle_sets(piece, k)
        node, component, own, other = (rows.column(x).to_numpy() for x in ("node", "component", "own", "other"))
        lo, hi = np.minimum(own, other), np.maximum(own, other)
        order = np.lexsort((node, hi, lo, component))
        c, x, y = component[order], lo[order], hi[order]
        cuts = np.flatnonzero((c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for at in np.split(order, cuts) if len(order) else ():
            nodes, first = np.unique(node[at], return_index=True)
            at = at[first]
            link_sets(nodes.tolist(), [sets[i] for i in at], own[at] == lo[at[0]], num, den, union, bool(lo[at[0]] != hi[at[0]]))
        pairs = [(union.find(x), x) for x in union.up]
        return pa.Table.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=_EDGES)

    small_batches(texts.sparkSession)
    return stored(wanted.groupBy("task").applyInArrow(verify, "a bigint, b bigint").where("a <> b"), "links")
