"""Exact removal of repeated passages over a corpus with sparse enhanced suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. A suffix array of all
positions would move many times the text, so its suffixes are anchored: each 50-byte window picks the 24-byte gram in
it with the least hash (content alone decides, so equal windows pick alike), and the windows of one anchor stay
together as its context. Contexts that meet are put into an enhanced suffix array by what follows the anchor; a stack
scan gives its interval tree, the test of what stands before the anchors leaves the maximal repeats with all their
occurrences (``esa.maximal_repeats``), and in each of these all occurrences go but those of the least doc_id. Then

1. documents are dealt into batches of bounded bytes by the least hash of their long lines, so that copies and near
   copies tend to meet, and lines with too many bytes for a batch are salted; what a batch can settle it settles, so a
   passage that a third of all documents share leaves a batch once;
2. the grams that batches still have to ask about meet by hash, and those of two batches or more go back;
3. contexts of these grams meet by gram, in as many buckets as the shuffle has partitions or more. A gram with more
   than ``CHUNK_CONTEXTS`` of them is dealt over several buckets by batch, each of which settles what it can;
4. what such buckets leave meets window by window, one row from each bucket;
5. the answers return to the batches, and the covered bytes go.

Hashes decide where strings meet and never whether they are equal: that is told by their bytes. No group holds more than
a batch, a bucket or a chunk of contexts, or a window's rows, one from each chunk.

Null texts are empty. Rows with the same doc_id do not count against each other. A null doc_id counts as the largest.
Texts under 50 bytes stay whole. Ties cannot be: of equal strings those of the least doc_id stay, all of them. Repeated
rows give a row each, extra columns of any name stay as they are, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.llm import esa
from quillon.llm.memory import claim, give_back
from quillon.llm.packed import slices, squeezed, steps, unsqueezed
from quillon.runtime import cut, ship, shuffle_width, table

WINDOW = 50
GRAM = 24
SPAN = WINDOW - GRAM + 1
BATCH_BYTES = 12 << 20
#: Contexts of one gram in a bucket; a gram with more is dealt over several.
CHUNK_CONTEXTS = 16_384
#: Lines that are heavier than a share of a batch are sent to all tasks up to this number, else joined.
SENT_LINES = 200_000
CHUNK = 1 << 16
_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW = {1: _U(0xC2B2AE3D27D4EB4F)}
with np.errstate(over="ignore"):
    for _k in (1, 2, 4):
        _POW[2 * _k] = _POW[_k] * _POW[_k]
_INDEX = _U((1 << 24) - 1)
_LAST = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(31)) * _M1
    x = (x ^ x >> _U(29)) * _M2
    return x ^ x >> _U(32)


def anchors(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: first and last window, anchor position, gram hash. No window crosses a text."""
    out: list[tuple] = []
    total = len(buf) - WINDOW + 1
    none = {"a": np.zeros(0, np.int64), "z": np.zeros(0, np.int64), "p": np.zeros(0, np.int64), "g": np.zeros(0, np.uint64)}
    if total <= 0:
        return none
    mark = np.zeros(len(buf) + 1, dtype=np.int8)
    long = ends - starts >= WINDOW
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long] - WINDOW + 1, -1)
    valid = np.cumsum(mark[:total], dtype=np.int8) > 0
    for c in range(0, total, CHUNK):
        n = min(CHUNK, total - c)
        ok = valid[c : c + n]
        if not ok.any():
            continue
        h = _BYTE[buf[c : c + n + WINDOW - 1]]
        h = h[:-1] * _POW[1] + h[1:]
        h = h[:-2] * _POW[2] + h[2:]
        h8 = h[:-4] * _POW[4] + h[4:]
        h = h8[:-8] * _POW[8] + h8[8:]
        h = _mix(h[:-8] * _POW[8] + h8[16:])
        m = h & ~_INDEX | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8):
            m = np.minimum(m[:-k], m[k:])
        m = np.minimum(m[: len(m) - (SPAN - 16)], m[SPAN - 16 :])
        i = np.flatnonzero(ok)
        p = (m[i] & _INDEX).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        last = np.append(first[1:], len(i)) - 1
        out.append((i[first] + c, i[last] + c, p[first] + c, h[p[first]]))
    if not out:
        return none
    a, z, p, g = (np.concatenate(x) for x in zip(*out, strict=True))
    cont = np.concatenate([[False], p[1:] == p[:-1]])  # a run that a chunk's end had cut
    first = np.flatnonzero(~cont)
    # mixed anew: anchors have the least hashes of all grams, and codes are to lie evenly
    return {"a": a[first], "z": z[np.append(first[1:], len(a)) - 1], "p": p[first], "g": _mix(g[first] ^ _M1)}


def resolve(buf: np.ndarray, a: np.ndarray, z: np.ndarray, p: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (context, first window, how many) of windows that also occur in a context of a smaller document.

    Contexts are buf[a : z + 50] with an anchor at p; buf has esa.PAD more bytes at either end, which a, z and p skip.
    """
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none, none
    left, right, place = p - a, z + WINDOW - p, p + esa.PAD
    cls = esa.classes(buf, place, left, right, _mix)
    least = np.full(cls.max() + 1, _LAST)
    np.minimum.at(least, cls, doc)
    later = np.flatnonzero(doc > least[cls])
    # one context for each class goes into the tree
    _, own = np.unique(np.where(doc == least[cls], cls, -1), return_index=True)
    own = own[doc[own] == least[cls[own]]]
    found = esa.maximal_repeats(buf, place[own], left[own], right[own], WINDOW)
    member, group = own[found.members], np.repeat(np.arange(len(found.count)), found.count)
    first = np.minimum.reduceat(doc[member], np.cumsum(found.count) - found.count) if len(group) else none
    hit = doc[member] > first[group]
    member, group = member[hit], group[hit]
    # other contexts of the least doc_id in a class have what their class has
    many = np.flatnonzero(doc == least[cls])
    rest = np.setdiff1d(many, own)
    at, n = p[member] - found.left[group], found.left[group] + found.right[group] - WINDOW + 1
    if len(rest) and len(member):
        order = np.argsort(cls[member], kind="stable")
        ours = cls[member][order]
        lo, hi = np.searchsorted(ours, cls[rest]), np.searchsorted(ours, cls[rest], side="right")
        pick = order[esa.ranges(lo, hi - lo)]
        twin = np.repeat(rest, hi - lo)
        at, n = np.concatenate([at, at[pick] - a[member[pick]] + a[twin]]), np.concatenate([n, n[pick]])
        member = np.concatenate([member, twin])
    return np.concatenate([later, member]), np.concatenate([a[later], at]), np.concatenate([z[later] - a[later] + 1, n])


def united(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Marks of the places in any of the ranges."""
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + n)[order]) if len(at) else at
    first = np.flatnonzero(np.concatenate([[True], at[1:] > end[:-1]])) if len(at) else np.zeros(0, np.int64)
    turn = np.zeros(size + 1, dtype=np.int8)
    turn[at[first]] += 1
    turn[end[np.append(first[1:], len(at)) - 1] if len(at) else first] -= 1
    return np.cumsum(turn[:-1], dtype=np.int8).view(bool)


class Batch:
    """The documents of a batch in order, their anchors, and the windows that the batch itself settles."""

    def __init__(self, rows: pa.Table):
        claim("suffixes")
        doc = pc.fill_null(rows.column("doc_id").cast(pa.int64()), _LAST).to_numpy()
        raw = rows.column("text").combine_chunks()
        if isinstance(raw, pa.ChunkedArray):
            raw = pa.concat_arrays(raw.chunks) if raw.num_chunks else pa.array([], pa.string())
        raw = pc.fill_null(raw.cast(pa.large_string()), "")
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        texts = raw.cast(pa.large_binary())
        del raw
        tie = np.array([hashlib.md5(t.as_buffer()).hexdigest() for t in texts]) if len(np.unique(doc)) < len(doc) else np.zeros(len(doc))
        self.order = np.lexsort((tie, size, doc))
        self.doc, self.size = doc[self.order], size[self.order].astype(np.int64)
        self.padded = np.frombuffer(b"".join([bytes(esa.PAD), *(texts[int(i)].as_buffer() for i in self.order), bytes(esa.PAD)]), dtype=np.uint8)
        self.buf = self.padded[esa.PAD : -esa.PAD]
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.runs = anchors(self.buf, self.ends, self.starts)
        self.owner = self.doc[np.searchsorted(self.ends, self.runs["a"], side="right")] if len(self.runs["a"]) else np.zeros(0, np.int64)
        self.told: list[tuple[np.ndarray, np.ndarray]] = []
        self._settled: np.ndarray | None = None
        g = self.runs["g"]
        o = np.argsort(g, kind="stable")
        if len(o):
            first = np.flatnonzero(np.concatenate([[True], g[o][1:] != g[o][:-1]]))
            lo, hi = np.minimum.reduceat(self.owner[o], first), np.maximum.reduceat(self.owner[o], first)
            c = np.sort(o[np.repeat(lo < hi, np.diff(np.append(first, len(o))))])
            self.add(*resolve(self.padded, *(self.runs[k][c] for k in "azp"), self.owner[c])[1:])

    def add(self, at: np.ndarray, n: np.ndarray) -> None:
        """Settle ranges of windows."""
        self.told.append((at, n))
        self._settled = None

    def settled(self) -> np.ndarray:
        if self._settled is None:
            self.told = [tuple(np.concatenate(x) for x in zip(*self.told, strict=True))] if self.told else []
            self._settled = united(*self.told[0], len(self.buf)) if self.told else np.zeros(len(self.buf), dtype=bool)
        return self._settled

    def open_runs(self) -> np.ndarray:
        """Runs with a window that is not settled."""
        a, z = self.runs["a"], self.runs["z"]
        if not len(a):
            return a
        bounds = np.column_stack([a, z + 1]).ravel()
        return np.flatnonzero(np.logical_or.reduceat(~self.settled(), bounds)[::2])

    def covered(self) -> np.ndarray:
        """Bytes in a settled window."""
        turn = np.flatnonzero(np.diff(np.concatenate([[False], self.settled(), [False]]).view(np.int8)))
        return united(turn[::2], turn[1::2] - turn[::2] + WINDOW - 1, len(self.buf))

    def codes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The open runs, the distinct codes of their grams in order, each run's code, and each code's runs."""
        r = self.open_runs()
        code, of, n = np.unique(self.runs["g"][r] >> _U(64 - bits), return_inverse=True, return_counts=True)
        return r, code, of, n


def bucket_of(code: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets in the order of codes."""
    return ((code >> _U(bits - 24)) * _U(buckets) >> _U(24)).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64).astype(np.int64)


def _tidy(f):
    """f for a group, its memory being handed back before the next one comes."""

    def one(rows: pa.Table) -> pa.Table:
        out = f(rows)
        give_back()
        return out

    def two(rows: pa.Table, other: pa.Table) -> pa.Table:
        out = f(rows, other)
        give_back()
        return out

    return two if f.__code__.co_argcount == 2 else one


_TYPES = {"key": pa.int32(), "batch": pa.int32(), "flags": pa.binary(), "data": pa.binary(), "text": pa.binary()}


def _table(rows: list[tuple], names: str) -> pa.Table:
    keys = names.split()
    return pa.table([pa.array(c, _TYPES[k]) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(keys), keys, strict=True)], names=keys)


def _batch_of(rows: pa.Table) -> int:
    return int(rows.column("batch")[0].as_py())


def _grams(buckets: int, bits: int):
    """For each bucket the codes of a batch, and how often those are open that are so many times."""

    def run(rows: pa.Table) -> pa.Table:
        _, code, _, n = Batch(rows).codes(bits)
        k, out = _batch_of(rows), []
        for b, x, y in slices(bucket_of(code, bits, buckets)):
            often = np.flatnonzero(n[x:y] > 1)
            out.append((b, k, squeezed(steps(code[x:y]), often, n[x:y][often])))
        return _table(out, "key batch data")

    return run


def _shared(chunk: int):
    """Which of a batch's codes other batches have too, and over how many chunks the frequent ones are dealt."""

    def run(rows: pa.Table) -> pa.Table:
        batch, key = rows.column("batch").to_pylist(), rows.column("key")[0].as_py()
        parts, uses = [], []
        for data in rows.column("data").to_pylist():
            step, often, n = unsqueezed(data)
            parts.append(np.cumsum(step, dtype=np.uint64))
            uses.append(np.ones(len(step), dtype=np.int64))
            uses[-1][often.astype(np.int64)] = n
        _, of, held = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        total = np.bincount(of, np.concatenate(uses)).astype(np.int64)
        edges, out = np.cumsum([0, *map(len, parts)]), []
        for k, x, y in zip(batch, edges[:-1], edges[1:], strict=True):
            mine = of[x:y]
            flag = held[mine] > 1
            if flag.any():
                hot = np.flatnonzero(flag & (total[mine] > chunk))
                out.append((key, k, np.packbits(flag).tobytes(), squeezed(hot, -(-total[mine[hot]] // chunk))))
        return _table(out, "key batch flags data")

    return run


def _contexts(buckets: int, bits: int):
    """For each bucket the contexts of a batch that other batches ask about."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _table([], "key batch data text")
        b, k = Batch(rows), _batch_of(rows)
        r, code, of, _ = b.codes(bits)
        flag, deal = np.zeros(len(code), dtype=bool), np.ones(len(code), dtype=np.int64)
        where = {key: (x, y) for key, x, y in slices(bucket_of(code, bits, buckets))}
        for key, bit, hot in zip(*(asked.column(c).to_pylist() for c in ("key", "flags", "data")), strict=True):
            x, y = where[key]
            flag[x:y] = np.unpackbits(np.frombuffer(bit, np.uint8), count=y - x)
            at, n = unsqueezed(hot)
            deal[x + at.astype(np.int64)] = n
        keep = flag[of]
        r, of = r[keep], of[keep]
        home = bucket_of(code, bits, buckets)[of]
        hot = deal[of] > 1
        home[hot] = (_mix(code[of[hot]] * _M2 + (_U(k) % deal[of[hot]].astype(np.uint64))) % _U(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        a, z, p = (b.runs[x][r] for x in "azp")
        raw, out = b.buf.tobytes(), []
        for key, x, y in slices(home[order]):
            o = order[x:y]
            meta = squeezed(steps(a[o]), z[o] - a[o], p[o] - a[o], steps(b.owner[r[o]].astype(np.uint64) ^ _U(1 << 63)), hot[o])
            out.append((key, k, meta, zstandard.compress(b"".join(raw[i : j + WINDOW] for i, j in zip(a[o].tolist(), z[o].tolist(), strict=True)), 3)))
        return _table(out, "key batch data text")

    return run


def _told(batch: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.lexsort((at, batch))
    return [(k, squeezed(steps(at[order][x:y]), n[order][x:y])) for k, x, y in slices(batch[order])]


def _answers(buckets: int):
    """What a bucket settles, and the windows of dealt grams that it leaves."""

    def run(rows: pa.Table) -> pa.Table:
        meta = [unsqueezed(x) for x in rows.column("data").to_pylist()]
        batch = np.repeat(rows.column("batch").to_numpy(), [len(m[0]) for m in meta])
        at = np.concatenate([_signed(m[0]) for m in meta])
        wide, off = (np.concatenate([m[k] for m in meta]).astype(np.int64) for k in (1, 2))
        doc = np.concatenate([(np.cumsum(m[3], dtype=np.uint64) ^ _U(1 << 63)).view(np.int64) for m in meta])
        hot = np.concatenate([m[4] for m in meta]) > 0
        buf = np.frombuffer(b"".join([bytes(esa.PAD), *(zstandard.decompress(x) for x in rows.column("text").to_pylist()), bytes(esa.PAD)]), np.uint8)
        size = wide + WINDOW
        a = np.cumsum(size) - size
        own, first, n = resolve(buf, a, a + wide, a + off, doc)
        out = [(k % buckets, k, data, None) for k, data in _told(batch[own], at[own] + first - a[own], n)]
        if hot.any():
            left = np.zeros(len(buf), dtype=bool)
            left[esa.ranges(a[hot], wide[hot] + 1)] = True
            left &= ~united(first, n, len(buf))
            w = np.flatnonzero(left)
            c = np.searchsorted(a, w, side="right") - 1
            home = _window_hash(buf, w) % _U(buckets)
            order = np.argsort(home, kind="stable")
            text = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)
            for key, x, y in slices(home[order].astype(np.int64)):
                o = order[x:y]
                i = c[o]
                data = squeezed(batch[i], at[i] + w[o] - a[i], doc[i].astype(np.uint64) ^ _U(1 << 63))
                out.append((key, -1, data, zstandard.compress(text[w[o] + esa.PAD].tobytes(), 1)))
        return _table(out, "key batch data text")

    return run


def _window_hash(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.full(len(at), WINDOW)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(-(-WINDOW // 8)):
        h = _mix(h ^ esa.word(buf, at + esa.PAD, size, k, 1))
    return h


def _last_answers(rows: pa.Table) -> pa.Table:
    """The answers so far, and those that windows of several buckets give."""
    out, meta, text = [], [], []
    for k, data, x in zip(*(rows.column(c).to_pylist() for c in ("batch", "data", "text")), strict=True):
        if x is None:
            out.append((k, data))
        else:
            meta.append(unsqueezed(data)), text.append(zstandard.decompress(x))
    if meta:
        batch, at = (np.concatenate([m[k] for m in meta]).astype(np.int64) for k in (0, 1))
        doc = (np.concatenate([m[2] for m in meta]) ^ _U(1 << 63)).view(np.int64)
        buf = np.frombuffer(b"".join([*text, bytes(esa.PAD)]), np.uint8)
        place, size = np.arange(len(at)) * WINDOW, np.full(len(at), WINDOW)
        own = esa.words(buf, place, size, 1)
        order = esa.ordered(own, size)
        first = np.flatnonzero(esa.prefixes(own, size, order) < WINDOW)
        least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
        c = order[doc[order] > least]
        out += _told(batch[c], at[c], np.ones(len(c), dtype=np.int64))
    return _table(out, "batch data")


def _settle(rows: pa.Table, told: pa.Table) -> tuple[Batch, np.ndarray]:
    b = Batch(rows)
    for data in told.column("data").to_pylist():
        at, n = unsqueezed(data)
        b.add(_signed(at), n.astype(np.int64))
    return b, b.covered()


def _digests(rows: pa.Table, told: pa.Table) -> pa.Table:
    b, cov = _settle(rows, told) if rows.num_rows else (None, np.zeros(0, bool))
    cols: list[list] = [[], [], [], []]
    for i in range(len(b.doc) if b else 0):
        s, z = int(b.starts[i]), int(b.ends[i])
        c = cov[s:z]
        gone = int(c.sum())
        spans = int(c[:1].sum()) + int((c[1:] & ~c[:-1]).sum()) if gone else 0
        kept = b.buf[s:z][~c] if gone else b.buf[s:z]
        for col, x in zip(cols, (z - s, gone, spans, hashlib.sha256(np.ascontiguousarray(kept)).hexdigest()), strict=True):
            col.append(x)
    doc = rows.column("doc_id").combine_chunks().take(pa.array(b.order)) if b else pa.array([], pa.int64())
    return pa.table([doc, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cleaned(rows: pa.Table, told: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return rows.select(["text", "rest"])
    b, cov = _settle(rows, told)
    own = rows.select(["text", "rest"]).take(pa.array(b.order))
    new = []
    for i, t in enumerate(own.column("text").to_pylist()):
        s, z = int(b.starts[i]), int(b.ends[i])
        # a cut may leave part of a character; such bytes go too
        new.append(b.buf[s:z][~cov[s:z]].tobytes().decode("utf-8", "ignore") if cov[s:z].any() else t)
    return own.set_column(0, "text", pa.array(new, own.schema.field("text").type))


def _run(docs: DataFrame, finish, schema: str | StructType, batch_bytes: int, chunk: int) -> DataFrame:
    """docs: doc_id long, text string and what finish needs, with no other names than its own."""
    spark = docs.sparkSession
    ship(spark)
    lines = F.filter(F.split("text", "\n"), lambda x: F.octet_length(x) >= WINDOW)
    keyed = docs.withColumn("deal", F.coalesce(F.array_min(F.transform(lines, lambda x: F.xxhash64(x))), F.xxhash64("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    by_key = cut(keyed.select("deal", size.alias("size")).groupBy("deal").agg(F.sum("size").alias("size")))
    most = max(1, batch_bytes // 4)
    heavy = by_key.where(F.col("size") > most).select("deal", F.ceil(F.col("size") / F.lit(most)).cast("long").alias("salts"))
    total, lines_sent = by_key.agg(F.sum("size"), F.sum((F.col("size") > most).cast("long"))).first()
    n = max(1, math.ceil((total or 0) / batch_bytes))
    # hash bits of a gram: so many that few of all grams meet another by chance
    bits = min(60, max(32, int(total or 1).bit_length() + 4))
    buckets = max(shuffle_width(spark), min(n, 4096))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "text"), F.col("salts")), F.lit(0))
    dealt = keyed.join(F.broadcast(heavy) if (lines_sent or 0) <= SENT_LINES else heavy, "deal", "left").withColumn("batch", F.pmod(F.xxhash64("deal", salt), F.lit(n)).cast("int")).drop("deal", "salts")
    own = dealt.select("doc_id", "text", "batch").groupBy("batch") if finish is _digests else dealt.groupBy("batch")
    asked = own.applyInArrow(_tidy(_grams(buckets, bits)), "key int, batch int, data binary")
    shared = asked.groupBy("key").applyInArrow(_tidy(_shared(chunk)), "key int, batch int, flags binary, data binary")
    ctx = own.cogroup(shared.groupBy("batch")).applyInArrow(_tidy(_contexts(buckets, bits)), "key int, batch int, data binary, text binary")
    told = ctx.groupBy("key").applyInArrow(_tidy(_answers(buckets)), "key int, batch int, data binary, text binary")
    last = told.groupBy("key").applyInArrow(_tidy(_last_answers), "batch int, data binary")
    return own.cogroup(last.groupBy("batch")).applyInArrow(_tidy(finish), schema)


def _told_columns() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]


def removed_spans(docs: DataFrame, batch_bytes: int = BATCH_BYTES, chunk: int = CHUNK_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all documents."""
    return _run(docs.select(*_told_columns()), _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", batch_bytes, chunk)


def suffix_dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES, chunk: int = CHUNK_CONTEXTS) -> DataFrame:
    """All documents, with the repeated passages cut from text; columns as they were."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*_told_columns(), F.struct(*others).alias("rest"))
    out = _run(rows, _cleaned, StructType([StructField("text", StringType()), rows.schema["rest"]]), batch_bytes, chunk)
    return out.select(*[F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE: dict[str, str] = {}
