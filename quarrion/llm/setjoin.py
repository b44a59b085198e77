"""N-gram Jaccard join by partition of the shingle universe.

Sizes fall into bands.  If the smaller of two sets lies in a band with largest size U, a Jaccard of at least t means a
symmetric difference of at most H = floor(U (1 - t) / t).  The band's universe is hashed into a ring of m = H + 1 + G
segments.  By the cycle lemma at least G + 1 segments i of a linked pair have no difference, and such that segments i and
i + 1 together differ in at most one shingle (a strong form of the pigeonhole principle).

The index entry of a segment is its subset.  Subsets of few shingles would meet by chance, so that

* empty ones are skipped: a set with at most G of them loses no link, since every linked pair has G + 1 segments to meet in
  and a subset that both share is empty for both.  A set with more than G keeps them all;
* small ones are joined with the one-deletion neighbourhood of the next segment: the next subset whole and with each one of
  its shingles left out, which two subsets share if they differ by one shingle at most;
* the others stand alone.

Up to which size a subset counts as small is a matter of cost, more entries against fewer chance meetings, and decided for each
band from the corpus counts.  Candidates are verified exactly; no link is lost and none is invented.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, factorial, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm import textvec as tv
from quarrion.llm.common import bounded_rows, free_name, join_groups, map_texts, slim, stored
from quarrion.llm.graph import components
from quarrion.llm.pairing import candidate_edges, verified_edges

#: Largest over smallest size of a band.
BAND_RATIO = 1.2
#: A verified candidate costs as much as so many index entries; a share of pairs taken to hold any one common shingle.
VERIFY_COST, COMMON = 20.0, 1 / 30
_KEY, _SEG, _NEXT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


@cache
def bands() -> list[tuple[int, int]]:
    """(smallest, largest) size of each band."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, int(lo * BAND_RATIO))
        out.append((lo, hi))
        lo = hi + 1
    return out


def band_of(n: int) -> int:
    lo, hi = 0, len(bands()) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if bands()[mid][1] < n:
            lo = mid + 1
        else:
            hi = mid
    return lo


def bands_for(n: int, num: int, den: int) -> range:
    """Bands where a set of n shingles can be the smaller or the larger set of a pair."""
    return range(band_of(-(-n * num // den)), band_of(n) + 1)


@dataclass(frozen=True)
class Plan:
    """How a band is indexed: segments, subsets that a set may skip, and the sizes up to which they are skipped and joined."""

    m: int
    spare: int
    skip: int
    join: int


def differences(band: int, num: int, den: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set lies in the band."""
    return bands()[band][1] * (den - num) // num


def plan_for(band: int, num: int, den: int, skip: int, join: int) -> Plan:
    """Spare segments for the skipped subsets of most sets: their mean number and two deviations at the band's low end."""
    least = differences(band, num, den) + 1
    spare = 0
    while skip >= 0:
        m = least + spare
        load = bands()[band][0] / m
        mean = m * sum(exp(-load) * load**z / factorial(z) for z in range(skip + 1))
        if spare >= mean + 2 * sqrt(mean) or spare >= least:
            break
        spare += 1
    return Plan(least + spare, spare, skip, join)


def allocate(counts: dict[int, int], num: int, den: int) -> dict[int, Plan]:
    """The cheapest plan for each band with so many sets; bands where only equal sets link have none."""
    out = {}
    for band, n in counts.items():
        if not differences(band, num, den):
            continue

        def cost(p: Plan, n=n, band=band) -> float:
            load = min(sum(bands()[band]) / 2 / p.m, 50.0)
            share = [exp(-load) * load**z / factorial(z) for z in range(60)]
            near = sum((share[z] + (share[z - 1] if z else 0)) ** 2 * COMMON ** max(0, z - 1) for z in range(60))
            entries = n * p.m * sum(share[z] * (1 + load * (z <= p.join)) for z in range(p.skip + 1, 60))
            meet = sum(share[z] ** 2 * COMMON**z * (near if z <= p.join else 1) for z in range(p.skip + 1, 60))
            return entries + VERIFY_COST * n * n / 2 * p.m * meet

        out[band] = min((plan_for(band, num, den, 0, join) for join in range(5)), key=cost)
    return out


def band_counts(steps: list[tuple[int, int, int]], num: int, den: int) -> dict[int, int]:
    """Sets of each band, from (least size, largest size, sets) of steps of size: every band that a size between may reach counts."""
    counts: dict[int, int] = {}
    for least, largest, c in steps:
        for band in range(bands_for(least, num, den).start, bands_for(largest, num, den).stop):
            counts[band] = counts.get(band, 0) + c
    return counts


def signature_keys(h: np.ndarray, band: int, plan: Plan) -> np.ndarray:
    """The index entries, as 64-bit keys, of a set (sorted distinct hashes) in a band."""
    m = plan.m
    steps = np.arange(m + 1, dtype=np.uint64)
    cuts = ((steps << np.uint64(32)) + np.uint64(m - 1)) // np.uint64(m)
    cuts[-1] = 1 << 32
    at = np.searchsorted(h >> np.uint64(32), cuts)  # segments are ranges of the hash space
    sums = np.zeros(len(h) + 1, np.uint64)
    g = tv.mix(h ^ _KEY)
    np.cumsum(g, out=sums[1:])
    subset = sums[at[1:]] - sums[at[:-1]]
    size = np.diff(at)
    base = tv.mix(subset + steps[:-1] * _SEG + np.uint64((band + 1) * int(_NEXT) & (1 << 64) - 1))
    small = size <= plan.skip
    skipped = small if np.count_nonzero(small) <= plan.spare else np.zeros(m, bool)
    few = np.flatnonzero((size <= plan.join) & ~skipped)
    alone = base[(size > plan.join) & ~skipped]
    if not len(few):
        return alone
    after = (few + 1) % m
    whole = tv.mix(base[few] + tv.mix(subset[after] + _NEXT))
    n = size[after]
    start = np.repeat(at[after], n)
    member = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
    without = tv.mix(np.repeat(base[few], n) + tv.mix(np.repeat(subset[after], n) - g[member] + _NEXT))
    return np.concatenate([alone, whole, without])


def set_hash(h: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a, b = tv.mix(h ^ _SEG), tv.mix(h + _NEXT)
    return int(a.sum(dtype=np.uint64)), int(b.sum(dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def jaccard_components(df: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case; a document's set holds its
    distinct k-word shingles, or its whole word sequence if that is shorter.  Two documents link when den * (intersection)
    >= num * (union).  ``component_id`` is the least id reachable by links, the own id included.  A null or empty text, or
    one without words, has an empty set and links with nothing.  Rows that share an id are one document for links, each
    with the size of its own set; a null id links with nothing and has a null component.  Equal sets link.  No rows
    give no rows; other columns are not read.
    """
    docs = slim(df, id_col, text_col)

    def measure(chunks):
        for batch, texts in chunks:
            sets = tv.shingle_sets(texts, k)
            marks = [set_hash(s) for s in sets]
            yield {"doc_id": batch.column(0), "n": [len(s) for s in sets], "s1": [_signed(a) for a, _ in marks], "s2": [_signed(b) for _, b in marks], "bytes": pc.binary_length(texts)}

    sets = stored(map_texts(docs, measure, "doc_id bigint, n bigint, s1 bigint, s2 bigint, bytes bigint"), "sets")
    real = sets.where("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("bytes").alias("bytes")), "classes")
    steps = list(bounded_rows(classes.groupBy(F.floor(F.log(1.05, "n")).alias("step")).agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("c"), F.sum("size").alias("t")), "steps"))  # a row for each 5 % of size
    counts = band_counts([(r.least, r.largest, r.c) for r in steps], num, den)
    plans = allocate(counts, num, den)
    expected = sum(n * 2 * plans[b].m for b, n in counts.items() if b in plans)

    def signatures(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
        for i, h in zip(ids, tv.shingle_sets(texts, k), strict=True):
            keys = [signature_keys(h, b, plans[b]) for b in (bands_for(len(h), num, den) if len(h) else ()) if b in plans]
            if keys:
                yield i, np.concatenate(keys), set_hash(h)[0]

    total = sum(r.t for r in steps)
    members = join_groups(sets.drop("bytes"), classes.where("size > 1").drop("bytes"), ["n", "s1", "s2"], "size", total).select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("size", F.lit(1).cast("bigint")).alias("size"))
    members = stored(members, "members")
    edges = candidate_edges(docs.where("doc_id is not null"), signatures, expected)
    # candidates are between representatives of equal sets, which link anyway
    of = members.where("doc_id is not null and n > 0").select("doc_id", "rep").distinct()
    edges = edges.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    edges = stored(edges.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "pairs")
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n"), F.max("bytes").alias("bytes"))
    linked = verified_edges(docs.where("doc_id is not null"), edges, sizes, k, num, den)
    # rows that share an id but not a set tie their representatives together
    tied = members.where("doc_id is not null and n > 0 and rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(classes.select(F.col("rep").alias("b")), "b", "left_semi")
    found = components(linked.unionByName(tied.select("a", "b"))).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    found = found.join(members.where("n > 0").groupBy("rep").agg(F.count(F.lit(1)).alias("_rows")), "rep")
    out = join_groups(members, found, ["rep"], "_rows", total)
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the least id of their component, with all their columns; rows with a null id stay."""
    flag = free_name(df.columns, "_dropped_id")
    gone = jaccard_components(df, k, num, den, id_col, text_col).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(flag)).distinct()
    return df.join(gone.hint("merge"), df[id_col] == gone[flag], "left_anti")  # ids grow with the data: never broadcast
