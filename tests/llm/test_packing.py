import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrion.llm import packing
from quarrion.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "|>", "\n\n"])), max_size=6).map("".join))
def test_ids_are_those_of_tokenizers(tokenizer, text):
    assert packing.token_ids(tokenizer_path(), text)[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_special_strings_and_long_runs(tokenizer):
    assert packing.token_ids(tokenizer_path(), "<|endoftext|>").tolist() == [50256, 0]
    for text in ("<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  z", "x<|endoftext|", " a  b \n\n c\t", "x" * 5000, "1234567890 don't we'll", "　\x1c\x85 z", ""):
        assert packing.token_ids(tokenizer_path(), text)[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def count_bins(lengths, most):
    room, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        if at < len(room):
            left = room.pop(at) - n
        else:
            bins, left = bins + 1, most - n
        if left:
            bisect.insort(room, left)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = packing.best_fit(histogram, 40)
    assert bins == count_bins(lengths, 40)
    used, taken = {}, {}
    for r in runs:
        assert r.lo == taken.get(r.length, 0)
        taken[r.length] = r.hi
        for rank in range(r.hi - r.lo):
            b, place = r.bin + rank // r.per, r.offset + rank % r.per * r.length
            assert used.get(b, 0) == place  # gapless, in order
            used[b] = place + r.length
    assert taken == histogram and all(0 < n <= 40 for n in used.values()) and set(used) == set(range(bins))


def test_capacity_tree():
    tree, rng, have = packing.CapacityTree(100), random.Random(1), set()
    for _ in range(2000):
        c = rng.randrange(101)
        have ^= {c}
        tree.mark(c, c in have)
        n = rng.randrange(101)
        assert tree.tightest(n) == min((x for x in have if x >= n), default=None)


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_pack_against_brute_force(docs_of, odd_rows, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    rows = [r for r in odd_rows if r[0] != 7] + [(50, "one <|endoftext|> two<|endoftext|>")] + [(100 + i, "some words " * (i % 37)) for i in range(150)]
    got = packing.pack(docs_of(rows, extra=True), tokenizer_path(), 64, with_ids=True)
    by_doc, by_bin = {}, {}
    for r in got.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(n, *c) for n, c in enumerate(packing.cut(len(ids), 64))]
        assert [x for r in parts for x in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in parts)
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_bin) == count_bins([r.length for p in by_bin.values() for r in p], 64)
    whole = packing.sequences(got).collect()
    assert len(whole) == len(by_bin) and all(len(s.ids) == sum(p.length for p in s.spans) for s in whole)


def test_repeated_rows_and_empty_table(docs_of):
    df = docs_of([(1, "a b"), (1, "a b"), (None, "c"), (None, None)])
    got = packing.pack(df, tokenizer_path(), 16).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert packing.pack(df.limit(0), tokenizer_path(), 16).collect() == []


def test_added_tokens_with_flags_are_refused(tmp_path):
    import json

    file = json.load(open(tokenizer_path(), encoding="utf-8"))
    file["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError, match="surroundings"):
        packing.token_ids(str(path), "a")
