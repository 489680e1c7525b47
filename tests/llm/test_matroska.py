import hashlib
import random
import zlib

import pytest

from quillon.llm import matroska as M


def test_round_trip_and_table():
    rng = random.Random(9)
    for n in [64, 128, 64 * 255, 64 * 256, 64 * 1020, 64 * 1021, 64 * 5000]:
        p = rng.randbytes(n)
        raw = M.mux(p)
        got = M.packets(raw)
        assert M.payload_of(raw, got) == p and len(got) == n // 64
        assert all(x.track == 1 and x.size == 64 and x.key for x in got)
        assert [x.time_ns for x in got] == [k * 8_000_000 for k in range(n // 64)]
        for t, track, at in M.cues(raw):
            assert track == 1 and raw[at : at + 4] == bytes.fromhex("1f43b675")
            assert any(x.time_ns == t and x.start > at for x in got)


def test_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 255, b"", b"c" * 10, b"d" * 700]
    xiph = bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])

    def signed(d):
        for k in range(1, 9):
            bias = (1 << 7 * k - 1) - 1
            if -bias <= d <= bias:
                return (d + bias | 1 << 7 * k).to_bytes(k, "big")

    ebml = bytes([len(frames) - 1]) + M.vint(300) + b"".join(signed(len(b) - len(a)) for a, b in zip(frames, frames[1:-1], strict=False))
    blocks = M.element(M.SIMPLE, b"\x81\x00\x05\x82" + xiph + b"".join(frames))
    blocks += M.element(M.GROUP, M.element(M.BLOCK, b"\x40\x81\xff\xff\x06" + ebml + b"".join(frames)) + M.number(M.REFERENCE, 1))
    cluster = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + M.number(M.TIME, 100) + blocks
    raw = M._HEAD + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + M._TRACK + cluster + M.element(M.CUES, b"")
    got = M.packets(raw)
    assert [raw[p.start : p.start + p.size] for p in got] == frames * 2
    assert [(p.track, p.time_ns // 10**6, p.key) for p in got[::5]] == [(1, 105, True), (129, 99, False)]
    assert [p.time_ns for p in got[:5]] == [105_000_000 + i * 8_000_000 for i in range(5)]
    assert {p.time_ns for p in got[5:]} == {99_000_000}  # a track without an entry has no duration
    whole = M.mux(bytes(64 * 600))
    for bad in [b"", b"RIFF", raw[:20], *(whole[:k] for k in range(60, len(whole), 997))]:
        for f in (M.packets, M.tracks, M.cues):
            with pytest.raises(ValueError):
                f(bad)


def test_scale_and_tables(spark):
    about = M.element(M.INFO, M.number(M.SCALE, 500_000))
    block = M.element(M.SIMPLE, b"\x81\x00\x0a\x80xx")
    raw = M._HEAD + M.element(M.SEGMENT, about + M._TRACK + M.element(M.CLUSTER, M.number(M.TIME, 100) + block) + M.element(M.CUES, M.element(M.POINT, M.number(M.CUE_TIME, 100) + M.element(M.POSITIONS, M.number(M.CUE_TRACK, 1) + M.number(M.CUE_CLUSTER, 7)))))
    assert [p.time_ns for p in M.packets(raw)] == [55_000_000]
    media = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "doc_id long, media binary")
    assert [tuple(r) for r in M.track_table(media).collect()] == [(1, 1, 1, 2, "A_PCM/INT/LIT", 8_000_000, 8000.0, 1, 8)]
    assert [(r.doc_id, r.time_ns, r.track) for r in M.cue_table(media).collect()] == [(1, 50_000_000, 1)]
    assert [(r.doc_id, r.time_ns, r.size) for r in M.packet_table(media).collect()] == [(1, 55_000_000, 2)]


def test_query(docs_of, spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "word " * 30_000, "a"]
    docs = docs_of(texts).selectExpr("*", "1 as media", "2 as feature")
    got = {r.doc_id: r for r in M.read_back(M.stored(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert got[i].media_sha256 == hashlib.sha256(M.mux(p)).hexdigest() and got[i].media_bytes == len(M.mux(p))
    assert got[2].feature == got[7].feature
    assert M.packet_table(M.stored(docs)).count() == sum(r.payload_bytes // 64 for r in got.values())
    assert M.read_back(M.stored(docs_of([]))).count() == 0
