"""Column encodings as byte strings: plain, run-length, dictionary and delta, with LZ4 block compression over any of them.

Values are Arrow arrays without nulls of the four stored types.  ``encode`` and ``decode`` go by the encoding's name; every
decoder checks lengths and raises FormatError on input that is cut short or left over.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from quarrion.errors import FormatError

_WIDTH = {pa.int64(): "<i8", pa.float64(): "<f8"}


def _check(values: pa.Array) -> pa.Array:
    if values.null_count:
        raise FormatError("encodings take values without nulls; a null bitmap goes beside them")
    if values.type not in (pa.int64(), pa.float64(), pa.string(), pa.bool_()):
        raise FormatError(f"values of type {values.type} have no encoding")
    return values


def _u32(b: bytes, at: int) -> tuple[int, int]:
    if at + 4 > len(b):
        raise FormatError("the input is cut short")
    return struct.unpack_from("<I", b, at)[0], at + 4


def _items(values: pa.Array) -> list[bytes]:
    """Each value's bytes; a string's follow their length."""
    if values.type == pa.string():
        return [struct.pack("<I", len(x)) + x for x in (v.encode() for v in values.to_pylist())]
    if values.type == pa.bool_():
        return [b"\1" if v else b"\0" for v in values.to_pylist()]
    b = values.to_numpy().astype(_WIDTH[values.type]).tobytes()
    return [b[i : i + 8] for i in range(0, len(b), 8)]


def _strings(b: bytes, at: int, n: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        size, at = _u32(b, at)
        if at + size > len(b):
            raise FormatError("the input is cut short")
        out.append(b[at : at + size].decode())
        at += size
    return out, at


def _values(b: bytes, at: int, n: int, kind: pa.DataType) -> tuple[pa.Array, int]:
    """n values as ``_items`` lays them out."""
    if kind == pa.string():
        out, at = _strings(b, at, n)
        return pa.array(out, kind), at
    width = 1 if kind == pa.bool_() else 8
    if at + n * width > len(b):
        raise FormatError("the input is cut short")
    raw = np.frombuffer(b, np.uint8 if width == 1 else _WIDTH[kind], n, at)
    return pa.array(raw.astype(bool) if width == 1 else raw, kind), at + n * width


def _whole(b: bytes, at: int) -> None:
    if at != len(b):
        raise FormatError(f"{len(b) - at} bytes are left over")


def _bits(values: pa.Array) -> np.ndarray:
    """Values as integers or strings that are equal if their bytes are: -0.0 differs from 0.0, a NaN equals itself."""
    if values.type == pa.float64():
        return values.to_numpy().view(np.int64)
    return values.to_numpy(zero_copy_only=False)


def plain(values: pa.Array) -> bytes:
    """Fixed-width values, length-prefixed strings, booleans as bits (least significant first)."""
    if _check(values).type == pa.bool_():
        return np.packbits(values.to_numpy(zero_copy_only=False), bitorder="little").tobytes()
    return b"".join(_items(values))


def from_plain(b: bytes, n: int, kind: pa.DataType) -> pa.Array:
    if kind == pa.bool_():
        if len(b) != -(-n // 8):
            raise FormatError(f"{len(b)} bytes do not hold {n} bits")
        return pa.array(np.unpackbits(np.frombuffer(b, np.uint8), count=n, bitorder="little").astype(bool))
    out, at = _values(b, 0, n, kind)
    _whole(b, at)
    return out


def run_length(values: pa.Array) -> bytes:
    """(value, length of its run) pairs."""
    if not len(_check(values)):
        return b""
    x = _bits(values)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    lengths = np.diff(np.append(first, len(x)))
    return b"".join(v + struct.pack("<I", n) for v, n in zip(_items(values.take(pa.array(first))), lengths.tolist(), strict=True))


def from_run_length(b: bytes, n: int, kind: pa.DataType) -> pa.Array:
    found, lengths, at = [], [], 0
    while at < len(b):
        value, at = _values(b, at, 1, kind)
        run, at = _u32(b, at)
        found.append(value)
        lengths.append(run)
    if sum(lengths) != n:
        raise FormatError(f"the runs hold {sum(lengths)} values, not {n}")
    if not found:
        return pa.array([], kind)
    return pa.concat_arrays(found).take(pa.array(np.repeat(np.arange(len(found)), lengths)))


def dictionary(values: pa.Array) -> bytes:
    """Number of entries, the entries in the order of their first place, number of values, an entry number for each."""
    x = _bits(_check(values))
    _, first, codes = np.unique(x, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entries = values.take(pa.array(first[order]))
    return struct.pack("<I", len(entries)) + b"".join(_items(entries)) + struct.pack("<I", len(values)) + rank[codes].astype("<u4").tobytes()


def from_dictionary(b: bytes, n: int, kind: pa.DataType) -> pa.Array:
    size, at = _u32(b, 0)
    if size > len(b):
        raise FormatError("the dictionary is larger than the input")
    entries, at = _values(b, at, size, kind)
    count, at = _u32(b, at)
    if count != n:
        raise FormatError(f"the input holds {count} values, not {n}")
    if at + 4 * count > len(b):
        raise FormatError("the input is cut short")
    codes = np.frombuffer(b, "<u4", count, at)
    _whole(b, at + 4 * count)
    if len(codes) and int(codes.max()) >= size:
        raise FormatError("an entry number is out of range")
    return entries.take(pa.array(codes.astype(np.int64)))


def delta(values: pa.Array) -> bytes:
    """Integers only: the first value, the number of differences, and these; sums wrap at 64 bits."""
    if _check(values).type != pa.int64():
        raise FormatError(f"delta encoding takes int64 values, not {values.type}")
    if not len(values):
        return b""
    x = values.to_numpy().view(np.uint64)
    return struct.pack("<QI", int(x[0]), len(x) - 1) + (x[1:] - x[:-1]).astype("<u8").tobytes()


def from_delta(b: bytes, n: int, kind: pa.DataType = pa.int64()) -> pa.Array:
    if kind != pa.int64():
        raise FormatError(f"delta encoding holds int64 values, not {kind}")
    if not n and not b:
        return pa.array([], pa.int64())
    if len(b) < 12:
        raise FormatError("the input is cut short")
    base, count = struct.unpack_from("<QI", b)
    if count != n - 1 or len(b) != 12 + 8 * count:
        raise FormatError(f"the input holds {count} differences in {len(b)} bytes, not {n - 1}")
    steps = np.append(np.array([base], np.uint64), np.frombuffer(b, "<u8", count, 12).astype(np.uint64))
    return pa.array(np.cumsum(steps, dtype=np.uint64).view(np.int64))


def compress(b: bytes) -> bytes:
    """Original size, compressed size (0: the bytes follow as they are), and an LZ4 block."""
    packed = pa.Codec("lz4_raw").compress(b, asbytes=True) if b else b""
    return struct.pack("<II", len(b), 0) + b if len(packed) >= len(b) else struct.pack("<II", len(b), len(packed)) + packed


def decompress(b: bytes) -> bytes:
    size, at = _u32(b, 0)
    packed, at = _u32(b, at)
    if len(b) - at != (packed or size):
        raise FormatError(f"{len(b) - at} bytes of data, {packed or size} expected")
    if not packed:
        return b[at:]
    try:
        out = pa.Codec("lz4_raw").decompress(b[at:], size, asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise FormatError(f"not an LZ4 block: {e}") from None
    if len(out) != size:
        raise FormatError(f"{len(out)} bytes after decompression, {size} expected")
    return out


ENCODINGS: dict[str, tuple[Callable[[pa.Array], bytes], Callable[[bytes, int, pa.DataType], pa.Array]]] = {
    "plain": (plain, from_plain), "rle": (run_length, from_run_length), "dictionary": (dictionary, from_dictionary), "delta": (delta, from_delta),
}


def encode(values: pa.Array, encoding: str, lz4: bool = False) -> bytes:
    if encoding not in ENCODINGS:
        raise FormatError(f"unknown encoding {encoding!r}; known are {', '.join(ENCODINGS)}")
    b = ENCODINGS[encoding][0](values)
    return compress(b) if lz4 else b


def decode(b: bytes, encoding: str, n: int, kind: pa.DataType, lz4: bool = False) -> pa.Array:
    if encoding not in ENCODINGS:
        raise FormatError(f"unknown encoding {encoding!r}; known are {', '.join(ENCODINGS)}")
    return ENCODINGS[encoding][1](decompress(b) if lz4 else b, n, kind)
