"""Vectorised hashing of words, shingles and character n-grams over Arrow text buffers.

All functions work on a chunk of texts at once: one byte array, the texts' offsets in it, and word positions.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]  # A-Z hash as a-z
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BLOCK = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, _BLOCK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


@dataclass
class Texts:
    """A chunk of texts: bytes, text offsets (n + 1), word starts and ends, and each text's first word (n + 1)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words_of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array without nulls, without a copy."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bytes of a piece of a long text.
PIECE_BYTES = 1 << 21


def pieces(text: pa.Array) -> list[pa.Array]:
    """A single text, cut before spaces into pieces of PIECE_BYTES or one word; no word and no n-gram of a word is cut."""
    data, offsets = raw(text)
    if len(data) <= PIECE_BYTES:
        return [text]
    spaces = np.flatnonzero(data == 0x20)
    cuts = [0]
    while len(data) - cuts[-1] > PIECE_BYTES:
        i = int(np.searchsorted(spaces, cuts[-1] + PIECE_BYTES, "right")) - 1
        if i < 0 or spaces[i] <= cuts[-1]:
            i += 1
        if i == len(spaces):
            break
        cuts.append(int(spaces[i]))
    ends = np.array([*cuts, len(data)], np.int64)
    whole = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    return [whole.slice(i, 1) for i in range(len(cuts))]


def split(texts: pa.Array) -> Texts:
    """Word positions of a large_string array without nulls."""
    return split_bytes(*raw(texts))


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> Texts:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Texts(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return Texts(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(t: Texts, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z folded to a-z if asked; by prefix sums, block by block."""
    code = FOLDED_CODE if folded else BYTE_CODE
    out = np.empty(len(t.starts), np.uint64)
    at = 0
    while at < len(t.starts):
        lo = t.starts[at]
        to = max(at + 1, int(np.searchsorted(t.starts, lo + _BLOCK)))
        hi = t.ends[to - 1]
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[t.data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = t.starts[at:to] - lo, t.ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * PLACE[63])
        at = to
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; the whole sequence as one if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    w = min(k, n)
    h = words[: n - w + 1] * PLACE[0]
    for j in range(1, w):
        h = h + words[j : n - w + 1 + j] * PLACE[j]
    return mix(h + np.uint64(w))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text (of at least k words), whatever k is; by prefix sums."""
    up, down = _power(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    if len(h) < 2:
        return h
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles."""
    t = split(texts)
    words = word_hashes(t)
    return [distinct(shingles(words[t.words_of(i)], k)) for i in range(len(t))]


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))

# Character n-grams

CODE32 = (_RNG.integers(1, 1 << 31, 256, dtype=np.uint64) * 2 + 1).astype(np.uint32)
PLACE32 = (_RNG.integers(1, 1 << 31, 8, dtype=np.uint64) * 2 + 1).astype(np.uint32)
#: Letters only: A-Z as a-z, bytes of other scripts as they are, the rest as a space.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
#: Every character, white space as a space; and the same with A-Z as a-z.
MARKS = np.arange(256, dtype=np.uint8)
MARKS[9:14] = 0x20
FOLDED = MARKS.copy()
FOLDED[65:91] = np.arange(97, 123)


def padded(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts through a byte map with a space before each and after the last, and where each text's space stands."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 0x20, np.uint8)
    mapped = fold[data]
    for i in range(n):
        out[offsets[i] + i + 1 : offsets[i + 1] + i + 1] = mapped[offsets[i] : offsets[i + 1]]
    return out, offsets[:-1] + np.arange(n)


def ngram_ids(stream: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the hashed n-gram that starts there, in ``bits`` bits, and whether it counts.

    An n-gram counts if only its first and last characters may be spaces: it never reaches over two words.
    """
    m = len(stream) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    code = CODE32[stream]
    h = code[:m] * PLACE32[0]
    for j in range(1, n):
        h += code[j : m + j] * PLACE32[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    full = stream != 0x20
    if n == 1:
        ok = full[:m].copy()
    elif n == 2:
        ok = full[:m] | full[1 : m + 1]
    else:
        ok = full[1 : m + 1].copy()
        for j in range(2, n - 1):
            ok &= full[j : m + j]
    return h >> np.uint32(32 - bits), ok
