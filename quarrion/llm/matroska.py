"""Media columns: a Matroska reader and a small PCM writer.

``parse`` walks the variable-length EBML elements of a file held in memory and returns its tracks, its cue points
and a packet table: one entry per frame with track, timestamp, key flag, lacing and the byte range in the file.
No payload is copied.  Segments and clusters of unknown size, Void and CRC-32 elements, SimpleBlocks, BlockGroups
and all four lacings (none, Xiph, fixed-size, EBML) are read; a truncated or broken file raises ``MatroskaError``, and so
do numbers of over eight bytes, times that no 64-bit count of nanoseconds holds, and floats that are not finite.
A track's content encodings (compression, header stripping, encryption) are reported, and its byte ranges are those of the
frames as stored.

``packets`` maps a table's media column to packet rows.  Null media give no rows, empty or broken media give one row
with a null packet and the reason in ``error``; extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.common import map_texts, slim, small_batches

# EBML element ids of the Matroska specification.
EBML, DOC_TYPE, SEGMENT, VOID, CRC32 = 0x1A45DFA3, 0x4282, 0x18538067, 0xEC, 0xBF
INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CONTENT_ENCODINGS, CONTENT_ENCODING, CONTENT_COMPRESSION, COMPRESSION_ALGORITHM, CONTENT_ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x5035
ALGORITHMS = {0: "zlib", 1: "bzlib", 2: "lzo1x", 3: "header stripping"}
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Elements that end a cluster or segment of unknown size.
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}


class MatroskaError(ValueError):
    pass


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0
    frame_ns: int = 0
    encodings: list[str] = field(default_factory=list)  # in file order


@dataclass
class Packet:
    track: int
    cluster: int
    timestamp_ns: int
    key: bool
    lacing: int
    offset: int
    length: int


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ns, track, absolute cluster position
    clusters: list[int] = field(default_factory=list)  # absolute positions


def _vint(b: bytes, at: int, end: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next position, and whether all value bits are ones (an unknown size)."""
    if at >= end:
        raise MatroskaError(f"a number is missing at byte {at}")
    head = b[at]
    n = 9 - head.bit_length()
    if n > 8 or at + n > end:
        raise MatroskaError(f"a number is broken at byte {at}")
    x = int.from_bytes(b[at : at + n], "big")
    low = x & ((1 << 7 * n) - 1)
    return (x if keep_marker else low), at + n, low == (1 << 7 * n) - 1


def _uint(b: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise MatroskaError(f"an integer of {end - at} bytes at byte {at}")
    return int.from_bytes(b[at:end], "big")


def _ns(x: float, at: int) -> int:
    """A time in nanoseconds, in the range of a 64-bit integer."""
    if not math.isfinite(x) or abs(x) >= 1 << 63:
        raise MatroskaError(f"the time of a block or cue is out of range at byte {at}")
    return round(x)


def _float(b: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise MatroskaError(f"a float of {end - at} bytes at byte {at}")
    x = 0.0 if end == at else struct.unpack(">f" if end - at == 4 else ">d", b[at:end])[0]
    if not math.isfinite(x):
        raise MatroskaError(f"a float is not finite at byte {at}")
    return x


def elements(b: bytes, at: int, end: int, stop: set[int] | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) of the elements in a range; an unknown size reaches to ``end``.

    ``stop``: ids that end the range, for parents of unknown size.
    """
    while at < end:
        kind, body, _ = _vint(b, at, end, True)
        if stop and kind in stop:
            return
        size, body, unknown = _vint(b, body, end, False)
        to = end if unknown else body + size
        if to > end:
            raise MatroskaError(f"element {kind:X} at byte {at} ends after its parent")
        if unknown and kind == CLUSTER:
            to = body
            for k, _, _, e in elements(b, body, end, _TOP):
                to = e
        yield kind, at, body, to
        at = to


def _frames(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, length) of the frames of a block's body."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError(f"a laced block is empty at byte {at}")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("Xiph lacing is cut short")
                size, at = size + b[at], at + 1
                if b[at - 1] != 255:
                    break
            sizes.append(size)
    elif lacing == EBML_LACING:
        for i in range(n - 1):
            start = at
            x, at, _ = _vint(b, at, end, False)
            sizes.append(x if i == 0 else sizes[-1] + x - ((1 << 7 * (at - start) - 1) - 1))
    else:
        if (end - at) % n:
            raise MatroskaError("fixed-size lacing does not divide the block")
        sizes = [(end - at) // n] * (n - 1)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError("laced frames are longer than their block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def _block(b: bytes, at: int, end: int, media: Media, cluster: int, base: int, simple: bool, key: bool, duration: int | None) -> None:
    number, at, _ = _vint(b, at, end, False)
    if at + 3 > end:
        raise MatroskaError(f"a block header is cut short at byte {at}")
    relative, flags = struct.unpack(">hB", b[at : at + 3])
    lacing = flags >> 1 & 3
    frames = _frames(b, at + 3, end, lacing)
    track = media.tracks.get(number)
    step = duration * media.scale // len(frames) if duration is not None else track.frame_ns if track else 0
    when = (base + relative) * media.scale
    pcm = track is not None and track.bits and track.codec.startswith("A_PCM") and track.rate > 0 and not track.encodings
    for offset, length in frames:
        when = _ns(when, at)
        media.packets.append(Packet(number, cluster, when, bool(flags & 0x80) if simple else key, lacing, offset, length))
        if pcm:  # such frames say how long they are
            when += _ns(length * 8 / (track.bits * max(1, track.channels)) * 1e9 / track.rate, at)
        else:
            when += step


def _track(b: bytes, at: int, end: int) -> Track:
    t = Track()
    for kind, _, s, e in elements(b, at, end):
        if kind == TRACK_NUMBER:
            t.number = _uint(b, s, e)
        elif kind == TRACK_TYPE:
            t.kind = _uint(b, s, e)
        elif kind == CODEC_ID:
            t.codec = b[s:e].rstrip(b"\0").decode("ascii", "replace")
        elif kind == DEFAULT_DURATION:
            t.frame_ns = _uint(b, s, e)
        elif kind == AUDIO:
            for k, _, s2, e2 in elements(b, s, e):
                if k == SAMPLING_FREQUENCY:
                    t.rate = _float(b, s2, e2)
                elif k == CHANNELS:
                    t.channels = _uint(b, s2, e2)
                elif k == BIT_DEPTH:
                    t.bits = _uint(b, s2, e2)
        elif kind == CONTENT_ENCODINGS:
            t.encodings += [_encoding(b, s2, e2) for k, _, s2, e2 in elements(b, s, e) if k == CONTENT_ENCODING]
    return t


def _encoding(b: bytes, at: int, end: int) -> str:
    for kind, _, s, e in elements(b, at, end):
        if kind == CONTENT_ENCRYPTION:
            return "encryption"
        if kind == CONTENT_COMPRESSION:
            algorithm = next((_uint(b, x, y) for k, _, x, y in elements(b, s, e) if k == COMPRESSION_ALGORITHM), 0)
            return ALGORITHMS.get(algorithm, f"algorithm {algorithm}")
    return ALGORITHMS[0]  # the defaults


def parse(b: bytes) -> Media:
    """Tracks, cues and packets of a Matroska file."""
    media, seen, doc_type = Media(), False, ""
    for kind, _, s, e in elements(b, 0, len(b)):
        if kind == EBML:
            for k, _, s2, e2 in elements(b, s, e):
                if k == DOC_TYPE:
                    doc_type = b[s2:e2].rstrip(b"\0").decode("ascii", "replace")
            if doc_type not in ("matroska", "webm"):
                raise MatroskaError(f"the document type is {doc_type!r}")
        elif kind == SEGMENT:
            if not doc_type:
                raise MatroskaError("no EBML header")
            seen = True
            _segment(b, s, e, media)
    if not seen:
        raise MatroskaError("no segment")
    return media


def _segment(b: bytes, at: int, end: int, media: Media) -> None:
    for kind, start, s, e in elements(b, at, end):
        if kind == INFO:
            for k, _, s2, e2 in elements(b, s, e):
                if k == TIMESTAMP_SCALE:
                    media.scale = _uint(b, s2, e2)
                elif k == DURATION:
                    media.duration = _float(b, s2, e2)
        elif kind == TRACKS:
            for k, _, s2, e2 in elements(b, s, e):
                if k == TRACK_ENTRY:
                    t = _track(b, s2, e2)
                    media.tracks[t.number] = t
        elif kind == CLUSTER:
            media.clusters.append(start)
            base = 0
            for k, _, s2, e2 in elements(b, s, e):
                if k == CLUSTER_TIMESTAMP:
                    base = _uint(b, s2, e2)
                elif k == SIMPLE_BLOCK:
                    _block(b, s2, e2, media, len(media.clusters) - 1, base, True, True, None)
                elif k == BLOCK_GROUP:
                    inner = list(elements(b, s2, e2))
                    duration = next((_uint(b, x, y) for i, _, x, y in inner if i == BLOCK_DURATION), None)
                    key = all(i != REFERENCE_BLOCK for i, *_ in inner)
                    for i, _, x, y in inner:
                        if i == BLOCK:
                            _block(b, x, y, media, len(media.clusters) - 1, base, False, key, duration)
        elif kind == CUES:
            for k, _, s2, e2 in elements(b, s, e):
                if k == CUE_POINT:
                    inner = list(elements(b, s2, e2))
                    when = next((_uint(b, x, y) for i, _, x, y in inner if i == CUE_TIME), 0)
                    for i, _, x, y in inner:
                        if i == CUE_TRACK_POSITIONS:
                            p = {k3: _uint(b, x3, y3) for k3, _, x3, y3 in elements(b, x, y)}
                            media.cues.append((_ns(when * media.scale, x), p.get(CUE_TRACK, 0), at + p.get(CUE_CLUSTER_POSITION, 0)))


# Writing


def vint(x: int, width: int = 0) -> bytes:
    """A size or number with its length marker, as short as can be unless a width is given."""
    n = width or next(n for n in range(1, 9) if x < (1 << 7 * n) - 1)
    return (x | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """A block's body after its header."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += vint(len(frames[0]))
        for a, b in zip(frames[:-2], frames[1:-1], strict=True):
            d = len(b) - len(a)
            n = next(n for n in range(1, 9) if abs(d) < (1 << 7 * n - 1) - 1)
            head += vint(d + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


#: Samples of a frame, frames of a block and blocks of a cluster that ``write_pcm`` makes.
FRAME, LACED, BLOCKS = 2048, 8, 8
RATE = 8000


def write_pcm(samples: bytes) -> bytes:
    """A one-track Matroska file of unsigned 8-bit mono PCM at 8 kHz, laced, with cues for every cluster."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    duration = struct.pack(">d", len(samples) * 1000 / RATE)
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, duration) + element(MUXING_APP, b"quarrion") + element(WRITING_APP, b"quarrion"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    per = FRAME * LACED * BLOCKS
    for start in range(0, len(samples), per):
        time = start * 1000 // RATE
        body = [uint(CLUSTER_TIMESTAMP, time)]
        for s in range(start, min(start + per, len(samples)), FRAME * LACED):
            frames = [samples[x : x + FRAME] for x in range(s, min(s + FRAME * LACED, len(samples)), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", s * 1000 // RATE - time, 0x80 | lacing << 1) + lace(frames, lacing)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_track(b: bytes, media: Media, track: int) -> bytes:
    """The bytes of a track's frames, in file order, by their byte ranges."""
    return b"".join(b[p.offset : p.offset + p.length] for p in media.packets if p.track == track)


# Tables

PACKETS = "packet int, track bigint, codec string, encodings string, cluster int, timestamp_ns bigint, is_key boolean, lacing int, byte_offset bigint, byte_length bigint, error string"


_PACKETS = pa.schema([("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int64()), ("codec", pa.string()), ("encodings", pa.string()), ("cluster", pa.int32()), ("timestamp_ns", pa.int64()), ("is_key", pa.bool_()), ("lacing", pa.int32()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("error", pa.string())])


def packet_rows(doc: int | None, b: bytes) -> Iterator[pa.RecordBatch]:
    """The packet table of one file, or one row with the reason why it has none."""
    try:
        m = parse(b)
        kinds = {n: (t.codec, ", ".join(t.encodings) or None) for n, t in m.tracks.items()}
        rows = [(doc, i, p.track, *kinds.get(p.track, (None, None)), p.cluster, p.timestamp_ns, p.key, p.lacing, p.offset, p.length, None) for i, p in enumerate(m.packets)]
    except MatroskaError as e:
        rows = [(doc, *[None] * 10, str(e))]
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(_PACKETS)], schema=_PACKETS)


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """The packet table of a binary column: one row for each frame, keyed by ``doc_id`` (the id column's value).

    ``encodings`` names the content encodings of the packet's track, null without any.  Null media give no rows, broken
    ones a row with an ``error``; null ids and repeated rows are kept as they are; no rows give no rows.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blob.is_valid:
                    yield from packet_rows(doc, blob.as_buffer().to_pybytes())

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"doc_id bigint, {PACKETS}")


def mux_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a Matroska file.

    A null text counts as empty; null ids and repeated rows are kept as they are; no rows give no rows.
    """

    def run(chunks):
        for batch, texts in chunks:
            yield {"doc_id": batch.column(0), "media": [write_pcm(payload_of(x.as_buffer().to_pybytes())) for x in texts]}

    return map_texts(slim(df, id_col, text_col), run, "doc_id bigint, media binary")


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 if text else 64)


def describe(b: bytes) -> tuple[bytes, str]:
    """The first track's payload, read back by its packet table, and features of its samples."""
    m = parse(b)
    number = min(m.tracks)
    payload = read_track(b, m, number)
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    used = counts[counts > 0] / len(x)
    centred = x >= 128
    values = {
        "codec": m.tracks[number].codec, "packets": len(m.packets), "clusters": len(m.clusters), "cues": len(m.cues),
        "last_ms": m.packets[-1].timestamp_ns // 1_000_000, "mean_milli": int(x.sum(dtype=np.int64)) * 1000 // len(x),
        "peak": int(x.max()), "distinct": len(used), "entropy_milli": int(round(float(-(used * np.log2(used)).sum()), 3) * 1000),
        "crossings": int(np.count_nonzero(centred[1:] != centred[:-1])), "rise": int(np.count_nonzero(x[1:] > x[:-1])),
    }
    return payload, ";".join(f"{k}={v}" for k, v in values.items())


MEDIA_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a Matroska file, read the stored bytes back and describe them.

    Null counts as empty (64 zero bytes); every row gives one row, repeated rows and ids included; an empty table gives
    an empty result.  One text is held at a time, so memory is bounded by the longest text.
    """

    def run(chunks):
        for batch, texts in chunks:
            rows = []
            for text in texts:
                b = text.as_buffer().to_pybytes()
                media = write_pcm(payload_of(b))
                payload, feature = describe(media)
                rows.append((len(b), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), feature))
            names = [x.split()[0] for x in MEDIA_FEATURES.split(", ")][1:]
            yield {"doc_id": batch.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_texts(slim(df, id_col, text_col), run, MEDIA_FEATURES)
