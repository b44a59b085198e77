import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.errors import FormatError
from quarrion.sources import codecs

KINDS = {pa.int64(): st.integers(-(2**63), 2**63 - 1), pa.float64(): st.floats(), pa.string(): st.text(max_size=6), pa.bool_(): st.booleans()}
ARRAYS = st.sampled_from(list(KINDS)).flatmap(lambda k: st.lists(KINDS[k], max_size=30).map(lambda v: pa.array(v, k)))


def same(a, b):
    return a.type == b.type and a.to_pylist().__repr__() == b.to_pylist().__repr__()


@settings(max_examples=150, deadline=None)
@given(ARRAYS, st.sampled_from(["plain", "rle", "dictionary"]), st.booleans())
def test_round_trip(values, name, lz4):
    assert same(codecs.decode(codecs.encode(values, name, lz4), name, len(values), values.type, lz4), values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30))
def test_delta_round_trip(values):
    a = pa.array(values, pa.int64())
    assert same(codecs.from_delta(codecs.delta(a), len(a)), a)


def test_known_bytes():
    assert codecs.plain(pa.array([True, False, True])) == b"\5"
    assert codecs.run_length(pa.array(["a", "a", "b"])) == b"\1\0\0\0a\2\0\0\0\1\0\0\0b\1\0\0\0"
    assert codecs.dictionary(pa.array([7, 5, 7], pa.int64())) == b"\2\0\0\0" + (7).to_bytes(8, "little") + (5).to_bytes(8, "little") + b"\3\0\0\0" + b"\0\0\0\0\1\0\0\0\0\0\0\0"
    assert codecs.delta(pa.array([10, 12], pa.int64())) == (10).to_bytes(8, "little") + b"\1\0\0\0" + (2).to_bytes(8, "little")


def test_floats_go_by_bits():
    a = pa.array([0.0, -0.0, float("nan"), float("nan")])
    assert len(codecs.run_length(a)) == 3 * 12


def test_ratios():
    n = 200_000
    equal, few = pa.array([7] * n, pa.int64()), pa.array([f"category-{i % 100:03d}" for i in range(n)])
    assert len(codecs.run_length(equal)) < 0.001 * len(codecs.plain(equal))
    assert 3 * len(codecs.dictionary(few)) < len(codecs.plain(few))
    assert 100 * len(codecs.compress(bytes(1_000_000))) < 1_000_000
    assert 100 * len(codecs.encode(pa.array(range(n), pa.int64()), "delta", lz4=True)) < 8 * n
    noise = os.urandom(4096)
    assert codecs.compress(noise)[8:] == noise and codecs.decompress(codecs.compress(noise)) == noise


@pytest.mark.parametrize("name", ["plain", "rle", "dictionary", "delta"])
def test_cut_input(name):
    a = pa.array([1, 1, 2, 3], pa.int64())
    b = codecs.encode(a, name)
    for wrong in (b[:-1], b + b"\0", b[:3]):
        with pytest.raises(FormatError):
            codecs.decode(wrong, name, 4, pa.int64())
    with pytest.raises(FormatError):
        codecs.decode(b, name, 5, pa.int64())
    with pytest.raises(FormatError):
        codecs.decompress(codecs.compress(b)[:-1])


def test_refusals():
    with pytest.raises(FormatError):
        codecs.delta(pa.array(["a"]))
    with pytest.raises(FormatError):
        codecs.plain(pa.array([1, None]))
    with pytest.raises(FormatError):
        codecs.encode(pa.array([1]), "zip")
    with pytest.raises(FormatError):
        codecs.decompress(b"\x10\0\0\0\4\0\0\0\xff\xff\xff\xff")
