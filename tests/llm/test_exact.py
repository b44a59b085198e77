import hashlib
import random
from collections import defaultdict

import pytest

from quarrion.llm import cuckoo


def test_filter_inserts_finds_and_deletes():
    f, rng = cuckoo.CuckooFilter(1 << 10), random.Random(3)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    for k in keys:
        f.insert(k)
    assert all(f.contains(k) for k in keys) and f.size == 3000
    false = sum(f.contains(rng.getrandbits(64)) for _ in range(20_000))
    assert false < 40
    for k in keys[:1500]:
        assert f.delete(k)
    assert all(f.contains(k) for k in keys[1500:])
    assert sum(f.contains(k) for k in keys[:1500]) < 10


def test_filter_overflow_is_reported():
    f = cuckoo.CuckooFilter(2)
    with pytest.raises(cuckoo.Overflow):
        for k in range(1, 100):
            f.insert(k * 0x9E3779B97F4A7C15 & cuckoo.MASK64)
    with pytest.raises(ValueError):
        cuckoo.CuckooFilter(3)


def test_index_resizes_verifies_and_deletes():
    index = cuckoo.DigestIndex(buckets=2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, d in enumerate(digests):
        assert index.get(d) is None
        index.put(d, (i, 1))
    assert index.resizes > 5 and all(index.get(d) == (i, 1) for i, d in enumerate(digests))
    twin = digests[0][:8] + b"other content".ljust(24)
    assert index.get(twin) is None and index.false_hits >= 1  # a hit of the filter that the content refutes
    index.put(twin, (9, 9))
    assert index.remove(digests[0]) and index.get(digests[0]) is None and index.get(twin) == (9, 9)
    assert not index.remove(digests[0])
    index.put(digests[0], (1, 1))
    assert index.get(digests[0]) == (1, 1) and dict(index.items())[twin] == (9, 9)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(docs_of, odd_rows):
    rng = random.Random(5)
    rows = odd_rows + [(100 + i, f"text {rng.randrange(40)}") for i in range(300)] + [(1000 + i, "hot copy") for i in range(400)]
    got = cuckoo.exact_dedup(docs_of(rows, extra=True).repartition(5))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_hot_groups_and_small_batches(docs_of, monkeypatch):
    monkeypatch.setattr(cuckoo, "MAP_DIGESTS", 7)
    rows = [(i, f"t{i % 50}") for i in range(500)]
    got = cuckoo.exact_dedup(docs_of(rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_eviction_keeps_the_index_bounded():
    index = cuckoo.DigestIndex()
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(100)]
    for i, d in enumerate(digests):
        index.add(d, (i, 1))
    assert [v for _, v in index.evict(60)] == [(i, 1) for i in range(60)] and index.filter.size == 40
    assert all(index.get(d) is None for d in digests[:60]) and all(index.get(d) for d in digests[60:])


def test_copies_with_ids_that_repeat(docs_of):
    rows = [(7, "a"), (7, "b"), (9, "a"), (9, "a"), (None, "c"), (None, "c"), (None, "a"), (None, None), (3, ""), (5, "d", "en", "x"), (5, "d", "de", "x")]
    left = cuckoo.drop_copies(docs_of(rows, extra=True))
    assert sorted(map(repr, left.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(7, "b"), (9, "a"), (None, "c"), (3, ""), (5, "d")])
    assert [r.lang for r in left.where("doc_id = 5").collect()] == ["de"] and left.columns == docs_of(rows, extra=True).columns


def test_hot_copies_that_share_an_id(docs_of):
    rows = [(1, "same")] * 300 + [(2, f"t{i % 7}") for i in range(70)]
    assert sorted(r.text for r in cuckoo.drop_copies(docs_of(rows)).collect()) == sorted(["same", *(f"t{i}" for i in range(7))])


def test_drop_copies_and_empty_table(docs_of):
    df = docs_of([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")], extra=True)
    left = cuckoo.drop_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5]
    assert cuckoo.exact_dedup(df.limit(0)).collect() == [] and cuckoo.drop_copies(df.limit(0)).collect() == []
