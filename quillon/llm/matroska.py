"""Matroska columns: EBML written and parsed into packet, track and cue tables, payloads read back by byte range.

``mux`` stores bytes as 8-bit PCM samples: an EBML header, and a segment with information, one audio track, clusters
of SimpleBlocks and cues. ``packets`` parses variable-length element ids and sizes (unknown sizes of segments and clusters
too), SimpleBlocks and BlockGroups, and no, Xiph, fixed-size or EBML lacing; it gives a row for each frame with track,
timestamp, byte range and key flag. Timestamps are nanoseconds: those of cluster and block times the segment's scale, and
within a lace the track's default duration for each frame before; where a track has none, a lace's frames have its time.
``tracks`` gives the track entries and ``cues`` the index. Encrypted, compressed or EBML-void content is not looked into.

A null or empty text is stored as 64 zero bytes, as a text without a doc_id is stored like any other. Equal texts give
equal files. Repeated rows give a row each; extra columns of any name are ignored; an empty table gives no rows, and a null
file no packets. Bytes that are not EBML, or that are cut off, raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import ship, table

FRAME = 64
RATE = 8000
LACED = 255
BLOCKS = 4
EBML, SEGMENT, INFO, SCALE, APP, WRITER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
FREQUENCY, CHANNELS, DEPTH, DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = {SEGMENT, CLUSTER, GROUP, CUES, POINT, POSITIONS, TRACKS, ENTRY, INFO}
_TOP = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


class Packet(NamedTuple):
    track: int
    time_ns: int
    start: int
    size: int
    key: bool


class Track(NamedTuple):
    number: int
    uid: int
    kind: int
    codec: str
    duration_ns: int | None
    frequency: float
    channels: int
    depth: int | None


def vint(n: int) -> bytes:
    """A size in the fewest bytes."""
    for k in range(1, 9):
        if n < (1 << 7 * k) - 1:
            return (n | 1 << 7 * k).to_bytes(k, "big")
    raise ValueError("a size is too large")


def read_vint(raw: bytes, at: int) -> tuple[int | None, int]:
    """(value, next position); None for the unknown size."""
    first = raw[at]
    if not first:
        raise ValueError("a size is too long")
    k = 9 - first.bit_length()
    if at + k > len(raw):
        raise ValueError("a size is cut off")
    v = int.from_bytes(raw[at : at + k], "big") & ((1 << 7 * k) - 1)
    return (None if v == (1 << 7 * k) - 1 else v), at + k


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_ABOUT = element(INFO, number(SCALE, 1_000_000) + element(APP, b"quillon") + element(WRITER, b"quillon"))
_TRACK = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(FREQUENCY, np.array([RATE], ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A file that holds the payload, a whole number of frames, as samples of track 1."""
    body, points = [_ABOUT, _TRACK], []
    place, span = len(_ABOUT) + len(_TRACK), FRAME * LACED * BLOCKS
    per_ms = RATE // 1000
    for at in range(0, len(payload), span):
        start = at // per_ms
        parts = [number(TIME, start)]
        for b in range(at, min(at + span, len(payload)), FRAME * LACED):
            frames = payload[b : b + FRAME * LACED]
            n = len(frames) // FRAME
            head = b"\x81" + (b // per_ms - start).to_bytes(2, "big", signed=True)
            parts.append(element(SIMPLE, head + (b"\x84" + bytes([n - 1]) if n > 1 else b"\x80") + frames))
        cluster = element(CLUSTER, b"".join(parts))
        points.append(element(POINT, number(CUE_TIME, start) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(points)))


def elements(raw: bytes, at: int, end: int):
    """(id, first byte of the body, end) of the elements in a range."""
    while at < end:
        first = raw[at]
        k = 9 - first.bit_length() if first else 9
        if k > 4:
            raise ValueError("not an EBML element id")
        key = int.from_bytes(raw[at : at + k], "big")
        size, body = read_vint(raw, at + k)
        if size is None:
            stop = end if key == SEGMENT else _unknown_end(raw, body, end)
        else:
            stop = body + size
        if stop > end:
            raise ValueError("an element is cut off")
        yield key, body, stop
        at = stop


def _unknown_end(raw: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element of the segment's level."""
    while at < end:
        k = 9 - raw[at].bit_length() if raw[at] else 9
        if k <= 4 and int.from_bytes(raw[at : at + k], "big") in _TOP:
            return at
        size, body = read_vint(raw, at + k)
        at = body + (size or 0)
    return end


def _frames(raw: bytes, body: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, ranges) of a block."""
    track, at = read_vint(raw, body)
    time, flags = int.from_bytes(raw[at : at + 2], "big", signed=True), raw[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, time, flags, [(at, end - at)]
    n = raw[at] + 1
    at += 1
    if lacing == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing does not fit")
        return track, time, flags, [(at + i * size, size) for i in range(n)]
    sizes = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while raw[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + raw[at])
            at += 1
    elif n > 1:
        first, at = read_vint(raw, at)
        sizes.append(first)
        for _ in range(n - 2):
            before = at
            v, at = read_vint(raw, at)
            v = v if v is not None else (1 << 7 * (at - before)) - 1
            sizes.append(sizes[-1] + v - ((1 << 7 * (at - before) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing does not fit")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return track, time, flags, list(zip(starts, sizes, strict=True))


def _whole(f: Callable) -> Callable:
    """Reads beyond the end of a file that is cut off are ValueErrors."""

    @wraps(f)
    def run(raw: bytes):
        if not raw.startswith(EBML.to_bytes(4, "big")):
            raise ValueError("not an EBML file")
        try:
            return f(raw)
        except IndexError as e:
            raise ValueError("the file is cut off") from e

    return run


def _segments(raw: bytes):
    """The first byte of each segment's body, and its parts."""
    for key, a, z in elements(raw, 0, len(raw)):
        if key == SEGMENT:
            yield a, list(elements(raw, a, z))


def _number(raw: bytes, span: tuple[int, int], otherwise: int | None = 0) -> int | None:
    return int.from_bytes(raw[span[0] : span[1]], "big") if span[1] > span[0] else otherwise


def _scale(raw: bytes, parts: list[tuple[int, int, int]]) -> int:
    """Nanoseconds of a tick."""
    found = [_number(raw, (c, x)) for top, b, y in parts if top == INFO for k, c, x in elements(raw, b, y) if k == SCALE]
    return found[0] if found else 1_000_000


def _entries(raw: bytes, parts: list[tuple[int, int, int]]) -> list[Track]:
    out = []
    for top, b, y in parts:
        if top != TRACKS:
            continue
        for entry, c, x in elements(raw, b, y):
            if entry != ENTRY:
                continue
            own = {k: (d, w) for k, d, w in elements(raw, c, x)}
            sound = {k: (d, w) for k, d, w in elements(raw, *own[AUDIO])} if AUDIO in own else {}
            none = (0, 0)
            f = sound.get(FREQUENCY, none)
            frequency = float(np.frombuffer(raw[f[0] : f[1]], f">f{f[1] - f[0]}")[0]) if f[1] - f[0] in (4, 8) else 8000.0
            codec = raw[slice(*own.get(CODEC, none))].rstrip(b"\0").decode("ascii", "replace")
            out.append(Track(_number(raw, own.get(NUMBER, none)), _number(raw, own.get(UID, none)), _number(raw, own.get(KIND, none)), codec, _number(raw, own.get(DURATION, none), None), frequency, _number(raw, sound.get(CHANNELS, none), 1), _number(raw, sound.get(DEPTH, none), None)))
    return out


@_whole
def tracks(raw: bytes) -> list[Track]:
    """The track entries, in order of the file."""
    return [t for _, parts in _segments(raw) for t in _entries(raw, parts)]


@_whole
def packets(raw: bytes) -> list[Packet]:
    """A row for each frame, in order of the file."""
    out: list[Packet] = []
    for _, parts in _segments(raw):
        scale, lasts = _scale(raw, parts), {t.number: t.duration_ns or 0 for t in _entries(raw, parts)}

        def tell(block: tuple, key: bool, base: int, scale: int = scale, lasts: dict[int, int] = lasts) -> None:
            track, t, _, spans = block
            first, step = (base + t) * scale, lasts.get(track, 0)
            out.extend(Packet(track, first + i * step, s, n, key) for i, (s, n) in enumerate(spans))

        for top, b, y in parts:
            if top != CLUSTER:
                continue
            base = 0
            for k, c, x in elements(raw, b, y):
                if k == TIME:
                    base = int.from_bytes(raw[c:x], "big")
                elif k == SIMPLE:
                    block = _frames(raw, c, x)
                    tell(block, bool(block[2] & 0x80), base)
                elif k == GROUP:
                    own = list(elements(raw, c, x))
                    for e, d, w in own:
                        if e == BLOCK:
                            tell(_frames(raw, d, w), all(o[0] != REFERENCE for o in own), base)
    return out


@_whole
def cues(raw: bytes) -> list[tuple[int, int, int]]:
    """(nanoseconds, track, byte of the cluster in the file) of every cue."""
    out = []
    for a, parts in _segments(raw):
        scale = _scale(raw, parts)
        for top, b, y in parts:
            if top != CUES:
                continue
            for _, c, x in elements(raw, b, y):
                time = 0
                for k, d, w in elements(raw, c, x):
                    if k == CUE_TIME:
                        time = int.from_bytes(raw[d:w], "big")
                    elif k == POSITIONS:
                        own = {e: int.from_bytes(raw[f:v], "big") for e, f, v in elements(raw, d, w)}
                        out.append((time * scale, own.get(CUE_TRACK, 0), a + own.get(CUE_CLUSTER, 0)))
    return out


def payload_of(raw: bytes, table_: list[Packet], track: int = 1) -> bytes:
    """The bytes of a track; neighbouring ranges are read together."""
    spans: list[list[int]] = []
    for p in table_:
        if p.track == track:
            if spans and spans[-1][1] == p.start:
                spans[-1][1] += p.size
            else:
                spans.append([p.start, p.start + p.size])
    return b"".join(raw[a:z] for a, z in spans)


def features(samples: bytes, table_: list[Packet]) -> str:
    """Frames, blocks' times, level and zero crossings of the samples, as text."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    v = np.arange(256)
    mean = float(n @ v) / len(x)
    rms = float(np.sqrt(n @ (v - 128.0) ** 2 / len(x)))
    over = x >= 128
    crossings = int(np.count_nonzero(over[1:] != over[:-1]))
    return f"frames={len(table_)};last_ms={table_[-1].time_ns // 1_000_000};mean={mean:.4f};rms={rms:.4f};crossings={crossings}"


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME))


def _store(batches):
    for b in batches:
        for at in range(0, b.num_rows, 200):
            own = [padded(t) for t in b.column(1).slice(at, 200).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 200), pa.array([n for n, _ in own], pa.int64()), pa.array([mux(p) for _, p in own], pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the file of every document."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _rows_of(f: Callable, types: dict[str, pa.DataType]) -> Callable:
    """Rows (doc_id, what f tells of a file), files of a batch one after the other."""

    def run(batches):
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = f(raw) if raw is not None else []
                cols = list(zip(*got, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(got), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types.values(), strict=True))], names=["doc_id", *types])

    return run


def _told(media: DataFrame, f: Callable, types: dict[str, pa.DataType], schema: str) -> DataFrame:
    ship(media.sparkSession)
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_rows_of(f, types), schema)


def packet_table(media: DataFrame) -> DataFrame:
    """A row (doc_id, track, time_ns, start, size, key) for each frame of a column ``media``."""
    types = {"track": pa.int32(), "time_ns": pa.int64(), "start": pa.int64(), "size": pa.int64(), "key": pa.bool_()}
    return _told(media, packets, types, "doc_id long, track int, time_ns long, start long, size long, key boolean")


def track_table(media: DataFrame) -> DataFrame:
    """A row for each track entry of a column ``media``."""
    types = {"track": pa.int32(), "uid": pa.int64(), "kind": pa.int32(), "codec": pa.string(), "duration_ns": pa.int64(), "frequency": pa.float64(), "channels": pa.int32(), "depth": pa.int32()}
    return _told(media, tracks, types, "doc_id long, track int, uid long, kind int, codec string, duration_ns long, frequency double, channels int, depth int")


def cue_table(media: DataFrame) -> DataFrame:
    """A row (doc_id, time_ns, track, cluster) for each cue of a column ``media``; cluster is a byte of the file."""
    return _told(media, cues, {"time_ns": pa.int64(), "track": pa.int32(), "cluster": pa.int64()}, "doc_id long, time_ns long, track int, cluster long")


def _read(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for raw in b.column(2).to_pylist():
            got = packets(raw)
            back = payload_of(raw, got)
            row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(raw), hashlib.sha256(raw).hexdigest(), features(back, got))
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of stored files."""
    return media.mapInArrow(_read, _OUT)


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(table(spark, sf_dir, "documents")))


QUERIES = {"op3_matroska": op3_matroska}
ORACLE: dict[str, str] = {}
