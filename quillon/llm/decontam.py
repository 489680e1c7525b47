"""Benchmark decontamination by Wu-Manber search for windows of benchmark words.

Texts are put in a normal form (A-Z lower-cased, words parted by one space) and laid out in a buffer. A block shift
table says how far the search may skip; the buffer is searched in many lanes at once, each with its own cursor. Where
the shift is zero, the bucket of the suffix block and the leading block select test strings, and a direct comparison
confirms each occurrence. Patterns are searched in classes of like length, so that a short one does not shorten the
skips of the rest. A pattern is a place in the benchmark's own buffer, so a worker needs less than 100 bytes for each window.

The benchmark is the query set. It goes to the workers in blocks of ``BLOCK_WINDOWS`` windows, about, each block being
searched in all documents; one block is the rule. Of later blocks only the documents that they hit move.

Null and blank texts have no words and no hits. A null doc_id is like any other. An item without words has no window;
items with the same text are told each, and repeated item_ids once. Repeated rows give a row each, judged by doc_id and
text, so rows of one doc_id with unlike texts have verdicts of their own. Extra columns of any name stay as they are. An
empty table gives no rows, and an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.esa import ranges
from quillon.llm.memory import claim, remembers
from quillon.runtime import ship, table

WINDOW = 13
BLOCK_WINDOWS = 1_500_000
LANE = 8192
#: Bits of the shift table: at least, at most.
BITS = (16, 24)
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MATCHERS: dict[bytes, "Matcher"] = {}
_U = np.uint64


remembers("decontam", _MATCHERS.clear)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def _codes(buf: bytes) -> np.ndarray:
    """Eight bytes from each position, as overlapping integers."""
    return np.ndarray(shape=(max(0, len(buf) - 7),), dtype="<u8", buffer=buf, strides=(1,))


class WuManber:
    """Occurrences of patterns in one class of length; a pattern is a place and a length in ``source``."""

    def __init__(self, source: bytes, start: np.ndarray, size: np.ndarray):
        self.source = source
        self.m = int(size.min())
        self.block = min(8, max(2, self.m // 2))
        self.mask = _U((1 << 8 * self.block) - 1)
        last = self.m - self.block
        self.bits = min(BITS[1], max(BITS[0], int(len(start) * (last + 1)).bit_length() + 2))
        self.shift = np.full(1 << self.bits, min(255, last + 1), dtype=np.uint8)
        codes = _codes(source)
        for j in range(max(0, last - 254), last + 1):  # a later place has the smaller shift and overrides
            self.shift[self._hash(codes[start + j] & self.mask)] = last - j
        key = self._test(codes[start + last] & self.mask, codes[start] & self.mask)
        order = np.argsort(key, kind="stable")
        self.keys, self.start, self.size, self.ids = key[order], start[order], size[order], order

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)

    @staticmethod
    def _test(suffix: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The bucket of a suffix block together with the leading block."""
        return suffix * _U(0xC2B2AE3D27D4EB4F) ^ (lead * _U(0x9E3779B97F4A7C15)) >> _U(17)

    def find(self, buf: bytes, n: int) -> list[tuple[int, int]]:
        """(start, pattern) of all occurrences in buf[:n]; buf has 8 bytes more at least."""
        codes, last = _codes(buf), self.m - self.block
        if n < self.m:
            return []
        cur = np.arange(last, n - self.block + 1, LANE, dtype=np.int64)
        end = np.minimum(cur + LANE, n - self.block + 1)
        found = []
        while len(cur):
            code = codes[cur] & self.mask
            s = self.shift[self._hash(code)]
            zero = s == 0
            if zero.any():
                at = cur[zero] - last
                key = self._test(code[zero], codes[at] & self.mask)
                lo = np.searchsorted(self.keys, key)
                maybe = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == key)
                hi = np.searchsorted(self.keys, key[maybe], side="right")
                for a, x, y in zip(at[maybe].tolist(), lo[maybe].tolist(), hi.tolist(), strict=True):
                    for k in range(x, y):
                        b, w = int(self.start[k]), int(self.size[k])
                        if buf.startswith(self.source[b : b + w], a):
                            found.append((a, int(self.ids[k])))
            cur = cur + np.maximum(s, 1)
            if not (keep := cur < end).all():
                cur, end = cur[keep], end[keep]
        return found


class Matcher:
    """All classes of a block of items in normal form: ``ids`` of the items, and their texts one after the other."""

    def __init__(self, ids: list[str], texts: list[bytes]):
        import xxhash

        self.ids = ids
        self.source = b"".join(texts) + bytes(16)
        edges = np.cumsum([0, *map(len, texts)])
        spaces = np.flatnonzero(np.frombuffer(self.source, np.uint8) == 32)
        n_spaces = np.diff(np.searchsorted(spaces, edges))
        words = np.maximum(n_spaces - 1, 0)
        count = np.where(words > 0, np.maximum(1, words - WINDOW + 1), 0)
        item = np.repeat(np.arange(len(ids)), count)
        wide = np.minimum(words, WINDOW)[item]
        first = ranges(np.cumsum(n_spaces) - n_spaces, count)  # the space before the first word
        start = spaces[first]
        size = spaces[first + wide] - start + 1
        # equal windows meet by hash of their words and are told by their bytes
        own = np.zeros(len(spaces) + WINDOW, dtype=np.uint64)
        own[: len(spaces)][np.repeat(words > 0, n_spaces)] = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter((xxhash.xxh64_intdigest(w) for w in [*t.split(), b""]), np.uint64) for t in texts if t.strip())])
        key = wide.astype(np.uint64)
        for j in range(WINDOW):
            key = np.where(j < wide, (key ^ own[first + j]) * _U(0x9E3779B97F4A7C15) + (key >> _U(29)), key)
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), dtype=bool)
        for k in (np.flatnonzero(key[order][1:] == key[order][:-1]) + 1).tolist():
            x, y = int(order[k - 1]), int(order[k])
            new[k] = self.source[start[x] : start[x] + size[x]] != self.source[start[y] : start[y] + size[y]]
        self.pattern = order[new]
        self.words = wide[self.pattern]
        self.item, self.edge = item[order], np.append(np.flatnonzero(new), len(order))
        self.searches = []
        start, size = start[self.pattern], size[self.pattern]
        kind = np.minimum(6, np.floor(np.log2(size)).astype(np.int64) + 1) if len(size) else size
        for c in np.unique(kind):
            own = np.flatnonzero(kind == c)
            self.searches.append((WuManber(self.source, start[own], size[own]), own))

    @classmethod
    def of(cls, payload: bytes) -> Matcher:
        claim("decontam")
        key = hashlib.sha256(payload).digest()
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = cls(*pickle.loads(payload))
        return _MATCHERS[key]

    def items(self, pattern: int) -> list[str]:
        return [self.ids[k] for k in self.item[self.edge[pattern] : self.edge[pattern + 1]].tolist()]

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: words, merged spans of hit words, items."""
        counts, parts, starts, at = [], [], [], 0
        for t in texts:
            w = words_of(t)
            counts.append(len(w))
            starts.append(at)
            parts.append(b" " + b" ".join(w) + b" \n")
            at += len(parts[-1])
        buf = b"".join(parts) + bytes(8)
        hits: dict[int, list[tuple[int, int]]] = {}
        edges = np.array(starts)
        for s, own in self.searches:
            for a, i in s.find(buf, at):
                d = int(np.searchsorted(edges, a, side="right")) - 1
                hits.setdefault(d, []).append((a - starts[d], int(own[i])))
        out = [(n, [], set()) for n in counts]
        for d, found in hits.items():
            spaces = np.flatnonzero(np.frombuffer(parts[d], np.uint8) == 32)
            spans: list[list[int]] = []
            first = np.searchsorted(spaces, [a for a, _ in found])
            for w, n in sorted({(int(w), int(self.words[p])) for w, (_, p) in zip(first, found, strict=True)}):
                if spans and w <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], w + n)
                else:
                    spans.append([w, w + n])
            out[d] = (counts[d], [(a, z) for a, z in spans], {i for p in {p for _, p in found} for i in self.items(p)})
        return out


def _scan(payload):
    def run(batches):
        m = Matcher.of(payload.value)
        for b in batches:
            docs, keys = b.column(0), b.column(2)
            for at in range(0, b.num_rows, 1000):
                got = m.search(b.column(1).slice(at, 1000).to_pylist())
                spans = [[x for s in g[1] for x in s] for g in got]
                yield pa.RecordBatch.from_arrays([docs.slice(at, 1000), keys.slice(at, 1000), pa.array([g[0] for g in got], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(g[2]) for g in got], pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "spans", "items"])

    return run


_HITS = "doc_id long, key long, n_words long, spans array<long>, items array<string>"


def _blocks(benchmark: DataFrame, block_windows: int):
    """Items in normal form, in blocks of bounded windows, read through one partition at a time."""
    ids: list[str] = []
    texts: list[bytes] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = words_of(r.text)
        ids.append(str(r.item_id))
        texts.append(b" " + b" ".join(words) + b" " if words else b"")
        size += len(words)
        if size >= block_windows:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids or not size:
        yield ids, texts


def _merged(spans: list[list[int]]) -> list[int]:
    out: list[list[int]] = []
    for a, z in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [x for s in out for x in s]


def _merge(batches):
    """Spans and items of the first block with those of later ones."""
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in ("spans", "items", "_spans", "_items")}
        spans = [_merged([s, *more]) if more else s for s, more in zip(cols["spans"], cols["_spans"], strict=True)]
        items = [sorted({*i, *(x for m in more for x in m)}) if more else i for i, more in zip(cols["items"], cols["_items"], strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "n_words")), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, spans, n_hit, items): spans is a flat list of half-open ranges of hit words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    got, more = None, None
    for k, block in enumerate(_blocks(benchmark, block_windows)):
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(pickle.dumps(block))), _HITS)  # a block's text
        if k == 0:
            got = found
            continue
        found = found.where("size(spans) > 0").select("doc_id", "key", "spans", "items", F.lit(k).alias("block"))
        more = found if more is None else more.unionByName(found)
    if more is not None:
        # a later block adds to the documents it occurs in only; repeated rows have the same hits
        more = more.dropDuplicates(["doc_id", "key", "block"]).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list("spans").alias("_spans"), F.collect_list("items").alias("_items"))
        got = got.join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left").drop("_doc", "_key").mapInArrow(_merge, _HITS)
    n_hit = F.expr("aggregate(sequence(0, cast(size(spans) / 2 as int)), 0L, (s, i) -> s + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0L))")
    return got.select("doc_id", "n_words", "spans", n_hit.alias("n_hit"), "items")


def _contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a passage of the benchmark; columns as they were.

    A document goes if a span of 13 words or more of it is hit, however long the rest is, or if hits, those of shorter
    items too, are a twentieth of its words. Rows are told by a hash of doc_id and text, so documents with a null or
    repeated doc_id are judged each by its text.
    """
    row = F.xxhash64(docs["doc_id"], docs["text"])
    hit = contamination(docs.select(row.alias("doc_id"), "text"), benchmark)
    passage = F.expr(f"exists(sequence(1, size(spans) + 1, 2), i -> coalesce(get(spans, i) - get(spans, i - 1), 0L) >= {WINDOW})")
    bad = hit.where((F.size("spans") > 0) & (passage | _contaminated())).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, row == bad["_bad"], "left_anti")


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LO}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
dgs AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM dg),
m AS (SELECT r, i, dgs.n, item_id FROM dgs JOIN win ON dgs.n = win.n AND dgs.g = win.g),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {"op7_wu_manber": op7_wu_manber}
ORACLE = {"op7_wu_manber": SQL}
