"""SimHash fingerprints and near-duplicate classes found with Golay-code fuzzy keys.

Each 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints at 2 or fewer differing bits
agree wholly on at least one segment, and differ by 2 bits at most on each other one. A segment's fuzzy keys are the
[23,12] Golay codewords nearest to it and to its 23 one-bit neighbours: one or six of them, and two segments at
distance 2 or less always share one. So a key is one segment as it is, with a fuzzy key of the next. Candidates that
share a key are verified by their bits. Keys with many fingerprints go another exact way: two fingerprints at 2 bits
or fewer share a one-bit neighbour, and at most 65 fingerprints share any such centre, so no group there is large.

Null and blank texts have no words and the fingerprint zero, which links like any other. Repeated doc_ids are kept as
rows; extra columns are ignored. Classes are told by fingerprints, so a null doc_id does no harm: it counts as the
largest, and the component_id of a class without any doc_id is null.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.runtime import cut, ship, shuffle_width, table

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fingerprints that share a key up to which candidates are compared one by one.
HOT_KEY = 256
#: Places of a bitmap that tells which rows may go.
SLOTS = 1 << 24
#: Keys in a bucket, about; those of frequent keys are not among them.
BUCKET_KEYS = 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GENERATOR = 0b101011100011


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle of a text, repeats included; none for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    total = np.zeros(64, dtype=np.int64)
    for c in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[c : c + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_texts(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text; equal texts are told once."""
    known = {t: fingerprint(shingle_hashes(t, shingle)) for t in set(texts)}
    return np.array([known[t] for t in texts], dtype=np.uint64)


def text_key() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _fingerprints(batches):
    for b in batches:
        fp = fingerprint_texts(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp): a hash of the text, and the fingerprint as a signed long."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the code's generator."""
    v = v.astype(np.int64).copy()
    for k in range(22, 10, -1):
        v ^= np.where(v >> k & 1, _GENERATOR << (k - 11), 0)
    return v


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Error pattern of each syndrome, and the syndromes of single bits."""
    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, dtype=np.int64), bits]
    i, j = np.triu_indices(23, 1)
    errors.append(bits[i] | bits[j])
    a, b, c = (x.ravel() for x in np.meshgrid(*[np.arange(23)] * 3, indexing="ij"))
    keep = (a < b) & (b < c)
    errors.append(bits[a[keep]] | bits[b[keep]] | bits[c[keep]])
    every = np.concatenate(errors)
    leader = np.zeros(2048, dtype=np.int64)
    leader[_syndromes(every)] = every
    return leader, _syndromes(bits)


_LEADER, _UNIT = _golay()


def fuzzy(segment: np.ndarray) -> np.ndarray:
    """For each 23-bit segment a row of 24 codeword indices of 12 bits, repeats included."""
    flips = np.concatenate([np.zeros(1, dtype=np.int64), 1 << np.arange(23, dtype=np.int64)])
    s = _syndromes(segment)[:, None] ^ np.concatenate([np.zeros(1, dtype=np.int64), _UNIT])
    return ((segment[:, None] ^ flips) ^ _LEADER[s]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    seg = [(fp & np.uint64((1 << 23) - 1)).astype(np.int64), (fp >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64), (fp >> np.uint64(46)).astype(np.int64)]
    rows, keys = [], []
    for k in range(3):
        near = np.sort(fuzzy(seg[(k + 1) % 3]), axis=1)
        fresh = np.ones(near.shape, dtype=bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append((k + 1) << 40 | seg[k][r] << 12 | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for b in batches:
        fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
        r, k = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r]), pa.array(rep[r])], names=["key", "fp", "rep"])


def _least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least node reachable, for nodes 0..n-1 of a small edge list."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, u, lab[v])
        np.minimum.at(new, v, lab[u])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _verify(bucket: pa.Table) -> pa.Table:
    """Edges (u, v) from each verified fingerprint of a bucket of keys to the least one it is linked to there."""
    key, fp, rep = (bucket.column(c).to_numpy() for c in ("key", "fp", "rep"))
    order = np.lexsort((rep, key))
    key, fp, rep = key[order], fp[order].view(np.uint64), rep[order]
    nodes, at = np.unique(rep, return_inverse=True)
    us, vs = [], []
    live = np.arange(len(key))
    k = 1
    while len(live):
        live = live[live + k < len(key)]
        live = live[key[live] == key[live + k]]
        hit = live[np.bitwise_count(fp[live] ^ fp[live + k]) <= MAX_BITS]
        us.append(at[hit]), vs.append(at[hit + k])
        k += 1
    u, v = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (us, vs))
    lab = _least_labels(u, v, len(nodes)) if len(u) else np.arange(len(nodes))
    linked = lab != np.arange(len(nodes))
    return pa.table({"u": nodes[linked], "v": nodes[lab[linked]]})


def _centres(batches):
    one = np.concatenate([np.zeros(1, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for b in batches:
        fp, rep = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ one).ravel().view(np.int64)), pa.array(np.repeat(rep, 65))], names=["centre", "rep"])


def links(distinct: DataFrame, hot_key: int | None = None) -> DataFrame:
    """Edges (u, v) between representatives whose fingerprints differ in 2 bits or fewer, enough to connect them all.

    ``distinct`` has one row (fp, rep) for each fingerprint, rep being unique.
    """
    spark = distinct.sparkSession
    keys = distinct.select("fp", "rep").mapInArrow(_keyed, "key long, fp long, rep long")
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (hot_key or HOT_KEY)).select("key")
    hot = cut(hot)
    # so many buckets that each has a bounded number of keys, of which a fingerprint has some 15
    buckets = max(96, 8 * shuffle_width(spark), 15 * distinct.count() // BUCKET_KEYS + 1)
    if hot.isEmpty():
        cold, wide = keys, None
    else:
        cold = keys.join(hot, "key", "left_anti")
        wide = keys.join(hot, "key", "left_semi").select("fp", "rep").distinct().mapInArrow(_centres, "centre long, rep long")
    near = cold.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_verify, "u long, v long")
    if wide is None:
        return near
    members = wide.groupBy("centre").agg(F.sort_array(F.collect_set("rep")).alias("m")).where(F.size("m") > 1)
    return near.unionByName(members.select(F.explode("m").alias("u"), F.col("m")[0].alias("v")).where("u <> v"))


def _told(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, key, class, component_id) of all rows; class is the least fingerprint of the component."""
    fps = cut(fingerprints(docs))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("_own")).withColumn("rep", F.col("fp"))
    labels = components(links(distinct.select("fp", "rep")))
    classes = distinct.join(labels, distinct.rep == labels.node, "left").select("fp", "_own", F.coalesce("component", "rep").alias("class"))
    least = classes.groupBy("class").agg(F.min("_own").alias("component_id"))
    return fps.join(classes.join(least, "class").drop("_own"), "fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of all documents; an empty table gives no rows."""
    return _told(docs).select("doc_id", "fp", "component_id")


def _slot(key) -> F.Column:
    return F.pmod(key, F.lit(SLOTS)).cast("int")


def keep_one(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows with the least doc_id of each class; columns as they were. told: (doc_id, key, class) of all rows.

    A null doc_id counts as the largest. Of a class without any doc_id one row stays, of the text with the least key.
    Only rows that share one of ``SLOTS`` places with a row that goes are moved, and told exactly.
    """
    spark = docs.sparkSession
    least = told.groupBy("class").agg(F.min("doc_id").alias("_least"), F.min("key").alias("_key"))
    last = F.col("doc_id").isNull()
    goes = F.when(last, F.col("_least").isNotNull() | (F.col("key") != F.col("_key"))).otherwise(F.col("doc_id") != F.col("_least"))
    gone = cut(told.join(least, "class").where(goes).select(F.col("doc_id").alias("_id"), F.col("key").alias("_text")).distinct())
    twice = cut(told.where(last).groupBy("key").count().where("count > 1").select(F.col("key").alias("_text")))
    slots = gone.select(_slot(F.col("_text"))).union(twice.select(_slot(F.col("_text")))).distinct().toArrow().column(0)
    bits = np.zeros(SLOTS, dtype=bool)
    bits[slots.to_numpy()] = True
    one = F.broadcast(spark.createDataFrame(pa.table({"_bits": pa.array([np.packbits(bits, bitorder="little").view("<i8")], pa.list_(pa.int64()))})))  # SLOTS / 8 bytes
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_key")).withColumn("_slot", _slot(F.col("_key")))
    may_go = F.expr("shiftrightunsigned(_bits[shiftright(_slot, 6)], _slot & 63) & 1L = 1L")
    some, sure = own.join(one, may_go).drop("_bits"), own.join(one, ~may_go).drop("_bits")
    held = some.join(gone, some["_doc"].eqNullSafe(gone["_id"]) & (some["_key"] == gone["_text"]), "left_anti")
    named, unnamed = held.where("_doc is not null"), held.where("_doc is null").dropDuplicates(["_key"])
    return sure.select("_row").unionByName(named.select("_row")).unionByName(unnamed.select("_row")).select("_row.*")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """The documents less all but the one with the least doc_id of each near-duplicate class; columns as they were."""
    return keep_one(docs, _told(docs).select("doc_id", "key", "class"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
