import struct
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrion.llm import matroska as m


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3))
def test_pcm_round_trip(piece, times):
    samples = m.payload_of(piece * (1, 1, 700, 3000)[times])
    b = m.write_pcm(samples)
    media = m.parse(b)
    assert m.read_track(b, media, 1) == samples and len(samples) % 64 == 0 and samples
    assert [c[2] for c in media.cues] == media.clusters
    assert [p.timestamp_ns // 1000 for p in media.packets] == sorted(p.timestamp_ns // 1000 for p in media.packets)


@pytest.mark.parametrize("lacing", [m.XIPH, m.FIXED, m.EBML_LACING])
@given(sizes=st.lists(st.integers(0, 700), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_lacings(lacing, sizes):
    if lacing == m.FIXED:
        sizes = [sizes[0]] * len(sizes)
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    body = m.lace(frames, lacing)
    assert [body[a : a + n] for a, n in m._frames(body, 0, len(body), lacing)] == frames


def test_vints():
    for x in (0, 1, 126, 127, 16382, 16383, 1 << 20, (1 << 49) - 2):
        b = m.vint(x)
        assert m._vint(b, 0, len(b), False) == (x, len(b), False)
    assert m._vint(b"\xff", 0, 1, False)[2] and m._vint(b"\x01" + b"\xff" * 7, 0, 8, False)[2]
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(m.MatroskaError):
            m._vint(bad, 0, len(bad), False)


def hand_made(cluster_size=None):
    """Two tracks, a block group with a duration, unknown sizes, void and CRC elements."""
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    track = lambda n, codec: m.element(m.TRACK_ENTRY, m.uint(m.TRACK_NUMBER, n) + m.uint(m.TRACK_TYPE, n) + m.element(m.CODEC_ID, codec) + m.uint(m.DEFAULT_DURATION, 40_000_000))
    info = m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 1_000_000))
    tracks = m.element(m.TRACKS, track(1, b"V_VP9") + track(2, b"A_OPUS"))
    simple = m.element(m.SIMPLE_BLOCK, m.vint(1) + struct.pack(">hB", 5, 0x80) + b"key")
    late = m.element(m.SIMPLE_BLOCK, m.vint(2) + struct.pack(">hB", -3, 0x80 | m.XIPH << 1) + m.lace([b"aa", b"b" * 300, b"c"], m.XIPH))
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.vint(1) + struct.pack(">hB", 45, 0) + b"delta") + m.uint(m.BLOCK_DURATION, 40) + m.element(m.REFERENCE_BLOCK, b"\xd8"))
    body = m.element(m.CRC32, b"abcd") + m.uint(m.CLUSTER_TIMESTAMP, 100) + simple + m.element(m.VOID, b"\0" * 9) + late + group
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body if cluster_size is None else m.element(m.CLUSTER, body)
    again = m.element(m.CLUSTER, m.uint(m.CLUSTER_TIMESTAMP, 200) + simple)
    return head + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.element(m.VOID, b"") + info + tracks + cluster + again


def test_packet_table_of_a_mixed_file():
    for sized in (None, True):
        b = hand_made(sized)
        media = m.parse(b)
        rows = [(p.track, p.cluster, p.timestamp_ns // 1_000_000, p.key, p.lacing, b[p.offset : p.offset + p.length][:5]) for p in media.packets]
        assert rows == [(1, 0, 105, True, 0, b"key"), (2, 0, 97, True, 1, b"aa"), (2, 0, 137, True, 1, b"bbbbb"), (2, 0, 177, True, 1, b"c"), (1, 0, 145, False, 0, b"delta"), (1, 1, 205, True, 0, b"key")]
        assert [t.codec for t in media.tracks.values()] == ["V_VP9", "A_OPUS"]


def test_damage_raises_its_own_error():
    b = m.write_pcm(bytes(range(256)) * 200)
    for wrong in (b"", b[:20], b[40:], b[:-200], b"RIFF" + b[4:]):
        with pytest.raises(m.MatroskaError):
            m.parse(wrong)


@settings(max_examples=400, deadline=None)
@given(st.booleans(), st.lists(st.tuples(st.integers(0, 2000), st.one_of(st.integers(0, 255).map(lambda x: bytes([x])), st.sampled_from([b"\xff" * 8, b"\x80" + b"\0" * 7, b"\0" * 7 + b"\1", b"\x7f\xf0" + b"\0" * 6]))), min_size=1, max_size=4))
def test_any_damage_gives_rows_or_an_error(pcm, changes):
    b = bytearray(m.write_pcm(m.payload_of(b"some text " * 20)) if pcm else hand_made())
    for at, new in changes:
        at %= len(b)
        b[at : at + len(new)] = new[: len(b) - at]
    rows = [r for batch in m.packet_rows(1, bytes(b)) for r in batch.to_pylist()]
    assert all((r["error"] is None) == (r["packet"] is not None) for r in rows)


def one_track(track=b"", base=0, scale=1_000_000, block=b"data", lead=b""):
    entry = m.element(m.TRACK_ENTRY, m.uint(m.TRACK_NUMBER, 1) + m.element(m.CODEC_ID, b"A_PCM/INT/LIT") + track)
    cluster = m.element(m.CLUSTER, lead + m.uint(m.CLUSTER_TIMESTAMP, base) + m.element(m.SIMPLE_BLOCK, m.vint(1) + struct.pack(">hB", 0, 0x80 | m.FIXED << 1) + m.lace([block, block], m.FIXED)))
    return m.element(m.EBML, m.element(m.DOC_TYPE, b"webm")) + m.element(m.SEGMENT, m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, scale)) + m.element(m.TRACKS, entry) + cluster)


def audio(rate):
    return m.element(m.AUDIO, m.element(m.SAMPLING_FREQUENCY, struct.pack(">d", rate)) + m.uint(m.BIT_DEPTH, 8))


@pytest.mark.parametrize("b", [one_track(base=1 << 63), one_track(base=1 << 40, scale=1 << 40), one_track(audio(5e-324)), one_track(audio(float("nan"))), one_track(audio(float("inf"))), one_track(lead=m.element(m.CLUSTER_TIMESTAMP, b"\1" * 9))])
def test_numbers_out_of_range_are_errors(b, spark):
    rows = [r for batch in m.packet_rows(7, b) for r in batch.to_pylist()]
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["doc_id"] == 7
    got = m.packets(spark.createDataFrame([(7, b), (8, one_track())], "doc_id bigint, media binary"), "doc_id", "media").collect()
    assert sorted((r.doc_id, r.error is None) for r in got) == [(7, False), (8, True), (8, True)]


def test_content_encodings_are_reported():
    encoding = lambda body: m.element(m.CONTENT_ENCODINGS, m.element(m.CONTENT_ENCODING, body))
    for body, want in ((m.element(m.CONTENT_COMPRESSION, m.uint(m.COMPRESSION_ALGORITHM, 3)), "header stripping"), (m.element(m.CONTENT_COMPRESSION, b""), "zlib"), (m.element(m.CONTENT_ENCRYPTION, b""), "encryption"), (m.element(m.CONTENT_COMPRESSION, m.uint(m.COMPRESSION_ALGORITHM, 9)), "algorithm 9")):
        rows = [r for batch in m.packet_rows(1, one_track(encoding(body) + audio(8000.0))) for r in batch.to_pylist()]
        assert [r["encodings"] for r in rows] == [want, want] and rows[1]["timestamp_ns"] == rows[0]["timestamp_ns"]
    assert [r["encodings"] for batch in m.packet_rows(1, one_track()) for r in batch.to_pylist()] == [None, None]


def test_features_of_texts(docs_of, odd_rows):
    got = m.media_features(docs_of(odd_rows, extra=True))
    rows = got.collect()
    assert len(rows) == len(odd_rows) and len({r.feature for r in rows if r.doc_id == 7}) == 1
    texts = dict(odd_rows)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        payload = b + b"\0" * (-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = m.write_pcm(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
    assert m.media_features(docs_of(odd_rows).limit(0)).collect() == []


def test_packet_rows(spark, docs_of):
    media = m.mux_texts(docs_of([(1, "hello " * 9000), (2, "")]))
    rows = m.packets(media, "doc_id", "media").collect()
    assert {r.doc_id for r in rows} == {1, 2} and sum(r.byte_length for r in rows if r.doc_id == 1) == 54_016
    odd = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, b"junk", "x")], "doc_id bigint, media binary, packet string")
    got = sorted((r.doc_id, r.packet, bool(r.error)) for r in m.packets(odd, "doc_id", "media").collect())
    assert got == [(2, None, True), (3, None, True)] and m.packets(odd.limit(0), "doc_id", "media").collect() == []
