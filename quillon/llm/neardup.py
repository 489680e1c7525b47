"""SimHash near-dedup at 5 words: documents with a Jaccard similarity of 0.8 or more, and chains of them.

Fingerprints of 5-word shingles that the Golay keys of ``simhash`` link are candidates, compared by their texts. Edits in
a few places can change more bits than the keys reach, so an exact join completes them. In any one order of all
shingles, two sets at 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of each. The order puts shingles
that a sample of documents repeats last, so that lines many documents have seldom meet; the sample decides the order
alone, never the result. Then

1. each set that has a shingle in its prefix with others is compared with the one there whose prefix has the fewest rarer
   shingles, and with the greatest, so a large group of near copies is mostly joined by as many comparisons as it has
   members;
2. pairs of sets that still lie in different classes and share a prefix shingle are compared if their places there and
   their sizes allow it, which the join itself looks at.

Pairs are told by their texts, after sketches have sorted out those that cannot be similar.

Words are those of op8 (A-Z lower-cased, parted by white space). Texts of fewer words are one shingle; null and blank
texts are the empty set, which is like itself alone. Shingles and sets are told by 64 bits. Of equal least doc_ids in a
class all rows with the least text key stay; a null doc_id counts as the largest; extra columns of any name stay as they
are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.memory import claim, give_back
from quillon.llm.packed import slices, squeezed, steps, unsqueezed
from quillon.llm.simhash import fingerprint, keep_one, shingle_hashes, text_key
from quillon.llm.simhash import links as simhash_links
from quillon.runtime import cut, remove, shared_path, ship, shuffle_width

SHINGLE = 5
#: One document of so many tells which shingles are frequent; of these so many at most are sent to the workers, 16 bytes
#: each. They decide the order of shingles alone.
SAMPLE = 10
FREQUENT = 2_000_000
#: Prefix shingles that a task packs together.
PACKED_ROWS = 1_500_000
SHARED = ["shingle", "node", "place", "c_node", "c_place", "h_node", "h_place"]
#: Nodes that a task remembers to have told.
SEEN = 500_000
#: Places of the smallest sketch.
LEAST_PLACES = 256
#: Places of a bitmap that keeps most texts that are not to be compared from being moved.
SLOTS = 1 << 24


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(shingle_hashes(text, shingle))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _all(batches):
    for b in batches:
        got = [shingles(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view("<i8") if got else np.zeros(0, dtype=np.int64))], names=["shingle"])


def _prefix(h: np.ndarray, known: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the order of all, by uses in the sample, then by hash; and how many are not known."""
    if not len(h):
        return h, 0
    cold = len(h)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hits = known[at] == h
        cold -= int(hits.sum())
        h = h[np.argsort(np.where(hits, uses[at], 0), kind="stable")]
    return h[: len(h) - (4 * len(h) + 4) // 5 + 1], cold


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles in as many places as it has shingles, or up to twice as many, a power of two."""
    places = max(LEAST_PLACES, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def may_be_similar(n: str, a: str, m: str, z: str) -> str:
    """SQL, false only for sets of n and m shingles below 0.8: each place that differs in parity is a shingle of one set
    alone. The longer sketch is folded to the other's places; if it is over twice as long the sizes are too unlike."""
    both = lambda x, y: f"aggregate(sequence(0, size({x}) - 1), 0, (s, i) -> s + bit_count(element_at({x}, i + 1) ^ element_at({y}, i + 1) ^ if(size({y}) > size({x}), element_at({y}, i + 1 + size({x})), 0L)))"
    return f"5L * least({n}, {m}) >= 4L * greatest({n}, {m}) and 9L * if(size({a}) <= size({z}), {both(a, z)}, {both(z, a)}) <= {n} + {m}"


def _sets(sent):
    def run(batches):
        import xxhash

        claim("neardup")
        seen: set[int] = set()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(2).to_pylist():
                every = shingle_hashes(t, SHINGLE)
                h = np.unique(every)
                node = xxhash.xxh64_intdigest(h.tobytes())
                fresh = node not in seen  # of copies in one task, one tells its shingles
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(node)
                first, cold = _prefix(h, *sent.value) if fresh else (h[:0], 0)
                for c, x in zip(cols, (node, len(h), first.tobytes() if fresh else None, cold, sketch(h) if fresh else None, fingerprint(every)), strict=True):
                    c.append(x)
            signed = [pa.array(np.array(cols[k], dtype=np.uint64).view(np.int64)) for k in (0, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed[0], pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64())), signed[1]], names=["doc_id", "key", "node", "n", "first", "cold", "bits", "fp"])
        give_back()

    return run


def _placed(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Prefix shingles of a batch of sets: shingle, row of the set, place there, and whether it is known as frequent."""
    raw = b.column("first").to_pylist()
    count = np.array([len(r) // 8 for r in raw], dtype=np.int64)
    row = np.repeat(np.arange(len(raw)), count)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(raw), "<u8"), row, pos, pos >= b.column("cold").to_numpy()[row]


def _frequent_ones(batches):
    """(shingle, node, place) of the frequent prefix shingles; place is n << 32 | pos."""
    for b in batches:
        shingle, row, pos, hot = _placed(b)
        place = b.column("n").to_numpy().astype(np.int64)[row[hot]] << 32 | pos[hot]
        yield pa.RecordBatch.from_arrays([pa.array(shingle[hot].view("<i8")), pa.array(b.column("node").to_numpy()[row[hot]]), pa.array(place)], names=["shingle", "node", "place"])


def _packed(buckets: int):
    """The other prefix shingles, of many sets together, in one row for each bucket of shingles."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            shingle, row, pos, hot = _placed(b)
            held.append((shingle[~hot], b.column("node").to_numpy()[row[~hot]].view("<u8"), b.column("n").to_numpy()[row[~hot]], pos[~hot]))
            size += len(held[-1][0])
            if size > PACKED_ROWS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        shingle, node, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        # prefixes begin with small hashes, so these are mixed to deal them evenly; a mixed hash tells its shingle
        mixed = shingle * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(mixed)
        bucket = ((mixed[order] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        keys, data = [], []
        for k, x, y in slices(bucket):
            o = order[x:y]
            own, first, of = np.unique(node[o], return_index=True, return_inverse=True)
            keys.append(k)
            data.append(squeezed(steps(mixed[o]), of, pos[o], own, n[o][first]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """The shingles of a bucket that several nodes have, with the centre and the greatest node of each."""
    cols: list[list[np.ndarray]] = [[], [], []]
    for data in rows.column("data").to_pylist():
        step, of, pos, own, n = unsqueezed(data)
        of = of.astype(np.int64)
        for c, x in zip(cols, (np.cumsum(step, dtype=np.uint64), own[of], n[of] << np.uint64(32) | pos), strict=True):
            c.append(x)
    shingle, node, place = (np.concatenate(c) for c in cols)
    order = np.lexsort((node, shingle))
    shingle, node, place = shingle[order], node[order], place[order]
    fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])])
    shingle, node, place = shingle[fresh], node[fresh], place[fresh]
    first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    many = np.diff(np.append(first, len(shingle)))
    early = np.lexsort((node, place & np.uint64(0xFFFFFFFF), shingle))  # groups stay where they are
    centre, last = np.repeat(early[first], many), np.repeat(first + many - 1, many)
    keep = np.flatnonzero(np.repeat(many > 1, many))
    give_back()
    out = [x[keep].view("<i8") for x in (shingle, node, place, node[centre], place[centre], node[last], place[last])]
    return pa.table([pa.array(x) for x in out], names=SHARED)


def _maybe(sent):
    """Rows whose key may be among those asked for."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value[b.column(0).to_numpy() & (SLOTS - 1)]))

    return run


def _verified(batches):
    for b in batches:
        seen: dict[str | None, np.ndarray] = {}
        a, z = ([seen[t] if t in seen else seen.setdefault(t, shingles(t)) for t in b.column(c).to_pylist()] for c in (2, 3))
        yield b.select(["u", "v"]).filter(pa.array([similar(x, y) for x, y in zip(a, z, strict=True)], pa.bool_()))


def _frequent(rows: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in ascending order, that three documents of the sample share, and their uses there; FREQUENT at most."""
    some = rows.where(F.pmod(F.col("key"), F.lit(sample)) == 0).select("text").mapInArrow(_all, "shingle long")
    often = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses")).where("uses > 2").orderBy(F.desc("uses"), "shingle").limit(FREQUENT).toArrow()
    known = often.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], often.column("uses").to_numpy()[order]


def _texts(rows: DataFrame, sets: DataFrame, asked: DataFrame, path: str) -> DataFrame:
    """(node, text) of the nodes asked for, one text for each; written to path."""
    spark = rows.sparkSession
    holders = sets.join(asked, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    holders = cut(holders)
    slots = holders.select(F.col("key").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().toArrow()
    bits = np.zeros(SLOTS, dtype=bool)
    bits[slots.column("slot").to_numpy()] = True
    some = rows.select("key", "text").mapInArrow(_maybe(spark.sparkContext.broadcast(bits)), "key long, text string")  # SLOTS bytes at most
    some.join(holders, "key").dropDuplicates(["node"]).select("node", "text").write.parquet(path)
    return spark.read.parquet(path)


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def _compared(pairs: DataFrame, rows: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """The pairs (u, v) of nodes that are similar: those that sketches leave are told by their texts."""
    pairs = cut(pairs.distinct())
    marks = _marks(sets.join(_nodes(pairs), "node", "left_semi"))
    likely = cut(pairs.join(marks.toDF("u", "n", "a"), "u").join(marks.toDF("v", "m", "z"), "v").where(may_be_similar("n", "a", "m", "z")).select("u", "v"))
    texts = _texts(rows, sets.select("node", "key"), _nodes(likely), path)
    both = likely.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "z"), "v").select("u", "v", "a", "z")
    return cut(both.mapInArrow(_verified, "u long, v long"))


def _marks(sets: DataFrame) -> DataFrame:
    return sets.where("bits is not null").select("node", "n", "bits").dropDuplicates(["node"])


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints the Golay keys link, enough to connect them all."""
    own = cut(sets.where("n > 0").select("fp", "node").distinct())
    least = own.groupBy("fp").agg(F.min("node").alias("rep"))
    near = simhash_links(least.select("fp", F.col("fp").alias("rep")))
    ends = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "z"), "v").select(F.col("a").alias("u"), F.col("z").alias("v"))
    return ends.union(own.join(least, "fp").where("node <> rep").select("node", "rep"))


def _near(n: str, i: str, m: str, j: str) -> str:
    """SQL, false only for sets of n and m shingles below 0.8 whose first common shingle is at i and j: what follows in
    both is too short."""
    return f"9L * least({n} - {i}, {m} - {j}) >= 4L * ({n} + {m})"


def _shared(sets: DataFrame, path: str) -> DataFrame:
    """(shingle, node, n, pos, hot, and node, n, pos of the centre c and the greatest node h) of the prefix shingles of
    several nodes, written to path. Shingles that the sample knows as frequent are hot: they are summed up before they
    move, so none gathers in a task; the others move packed."""
    spark = sets.sparkSession
    told = sets.where("first is not null").select("node", "n", "first", "cold")
    buckets = 2 * shuffle_width(spark)  # each has a bounded share of the shuffle
    cold = told.mapInArrow(_packed(buckets), "bucket int, data binary").groupBy("bucket").applyInArrow(_meet, ", ".join(f"{c} long" for c in SHARED))
    hot = told.mapInArrow(_frequent_ones, "shingle long, node long, place long")
    pos = F.col("place").bitwiseAND(0xFFFFFFFF)
    ends = hot.groupBy("shingle").agg(F.min("node").alias("lo"), F.max(F.struct("node", "place")).alias("h"), F.min(F.struct(pos.alias("pos"), "node", "place")).alias("c"))
    hot = hot.join(ends.where("lo < h.node"), "shingle").select("shingle", "node", "place", "c.node", "c.place", "h.node", "h.place").toDF(*SHARED)
    cold.withColumn("hot", F.lit(False)).unionByName(hot.withColumn("hot", F.lit(True))).write.parquet(path)
    own = spark.read.parquet(path)
    for k in ("", "c_", "h_"):
        own = own.withColumn(f"{k}n", F.shiftright(f"{k}place", 32).cast("int")).withColumn(f"{k}pos", F.col(f"{k}place").bitwiseAND(0xFFFFFFFF).cast("int"))
    return own


def links(rows: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """Labels (node, component) of all nodes that are similar to another; sets: as _sets gives them."""
    shared = _shared(sets, f"{path}-shared")
    ends = [shared.where(f"node <> {k}_node and " + _near("n", "pos", f"{k}_n", f"{k}_pos")).select(F.col("node").alias("u"), F.col(f"{k}_node").alias("v")) for k in "ch"]
    edges = _compared(ends[0].union(ends[1]).union(_by_fingerprint(sets)), rows, sets, f"{path}-1")
    labels = components(edges)
    rest = shared.select("shingle", "node", "place", "hot").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    same, lo, hi = Window.partitionBy("shingle"), F.min("component"), F.max("component")
    cold = rest.where("not hot").withColumns({"lo": lo.over(same), "hi": hi.over(same)}).where("lo < hi")
    hot = rest.where("hot")
    hot = hot.join(hot.groupBy("shingle").agg(lo.alias("lo"), hi.alias("hi")).where("lo < hi"), "shingle")
    near = "u_node < v_node and u_component <> v_component and " + _near("shiftright(u_place, 32)", "(u_place & 4294967295L)", "shiftright(v_place, 32)", "(v_place & 4294967295L)")
    more = None
    for open_ in (cold, hot):
        u, v = (open_.select("shingle", *[F.col(c).alias(f"{k}_{c}") for c in ("node", "place", "component")]) for k in "uv")
        pairs = u.join(v, (u["shingle"] == v["shingle"]) & F.expr(near)).select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
        more = pairs if more is None else more.union(pairs)
    return components(edges.unionByName(_compared(more, rows, sets, f"{path}-2")))


def classes(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, key, class) of all rows; key is a hash of the text. Tables written on the way are removed at the end."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(_frequent(rows, sample))  # bounded by FREQUENT
    path = shared_path(spark, "shingles")
    rows.mapInArrow(_sets(sent), "doc_id long, key long, node long, n int, first binary, cold int, bits array<long>, fp long").write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")
    labels = links(rows, sets, f"{path}/texts")
    out = cut(sets.select("doc_id", "key", "node").join(labels, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("class")))
    remove(spark, path)
    return out


def near_duplicates_dropped(docs: DataFrame) -> DataFrame:
    """The documents less all but the one with the least doc_id of each near-duplicate class; columns as they were."""
    return keep_one(docs, classes(docs))
