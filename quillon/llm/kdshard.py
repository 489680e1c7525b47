"""K-d tree partitioning of documents into shards of near-equal bytes.

Each node of the tree splits the rows it holds along its widest metadata dimension, at the weighted median (weights
are bytes) that shares them out in proportion to the shards on either side. The dimensions are orders that the rows have
themselves: the length on a log scale, the share of line ends and of digits, and the source and the language in the order
of their names. So rows of a shard are alike, and a reader that wants one language or one kind of text opens few shards.
Widths are scaled to the spread over the table; of equally wide dimensions the first is taken. A hash of doc_id and text
below each value orders rows with the same one, so a value that a third of all rows have can still be split.

Medians come from histograms in a few rounds over the whole table, all nodes of a level together; each round looks at
what its bin really spans, so a bin of one value goes to its hashes at once. Bounded numbers of bins reach the driver,
never rows. The law is ``bytes``: sizes of the shards are near equal.

Texts that are null or empty count 8 bytes; null sources and languages come first. Rows that are equal in doc_id and text
stay together in a shard, and each has its own slot. Extra columns of any name are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.graph import gapless_rank, salts_for
from quillon.runtime import cut, table

SHARDS = 24
BINS = 2048
#: A coordinate has HIGH bits of its value above LOW bits of the row's hash.
HIGH, LOW = 36, 24
DIMS = ("lang", "source", "length", "lines", "digits")


def _named(column: str) -> Column:
    """The first bytes of a name as a number that orders names; null is 0."""
    first = F.rpad(F.substring(F.hex(F.encode(F.col(column).cast("string"), "UTF-8")), 1, HIGH // 4), HIGH // 4, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("long"), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) and a coordinate of 60 bits for each dimension."""
    text = F.col("text").cast("string")
    raw = text.cast("binary")
    n = F.coalesce(F.octet_length(raw), F.lit(0)).cast("long")
    share = lambda chars: F.coalesce((F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))
    have = set(docs.columns)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n + 8).alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        *[(_named(c) if c in have else F.lit(0).cast("long")).alias(c) for c in ("lang", "source")],
        share("\n").alias("lines"),
        share("0123456789").alias("digits"),
    )
    tie = F.xxhash64("doc_id", "text_crc32").bitwiseAND((1 << LOW) - 1)
    top = (1 << HIGH) - 1
    part = lambda x: F.least(F.lit(top), x * F.lit(float(top))).cast("long")
    high = {"lang": F.col("lang"), "source": F.col("source"), "length": part(F.log2(F.col("size").cast("double")) / 48), "lines": part(F.col("lines")), "digits": part(F.col("digits"))}
    return base.select("doc_id", "size", "text_crc32", *[(F.shiftleft(high[d].cast("long"), LOW) + tie).alias(d) for d in DIMS])


def _node(splits: dict[int, tuple[str, int]], i: int = 0) -> Column:
    """A row's node: children of node i are 2i+1 and 2i+2; the left one has coordinates below the split."""
    if i not in splits:
        return F.lit(i)
    dim, at = splits[i]
    return F.when(F.col(dim) < at, _node(splits, 2 * i + 1)).otherwise(_node(splits, 2 * i + 2))


def widest(lo: dict[str, int], hi: dict[str, int], spread: dict[str, tuple[int, int]]) -> str:
    """The dimension whose values are spread most, in parts of the table's spread; hashes do not count."""
    width = lambda a, z: (z >> LOW) - (a >> LOW)
    return max(DIMS, key=lambda d: (width(lo[d], hi[d]) / max(1, width(*spread[d])), -DIMS.index(d)))


def _split_level(rows: DataFrame, nodes: dict[int, int], spread: dict[str, tuple[int, int]]) -> dict[int, tuple[str, int]]:
    """Splits of the nodes (node: shards) of a level; rows have a column node."""
    stats = rows.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    state = {}
    for r in stats:
        dim = widest({d: r[f"lo_{d}"] for d in DIMS}, {d: r[f"hi_{d}"] for d in DIMS}, spread)
        k = nodes[r.node]
        state[r.node] = {"dim": dim, "lo": r[f"lo_{dim}"], "hi": r[f"hi_{dim}"] + 1, "want": r.w * (k // 2) / k, "all": r.w}
    live = {i: s for i, s in state.items() if s["hi"] - s["lo"] > 1}
    while live:
        step = {i: max(1, -(-(s["hi"] - s["lo"]) // BINS)) for i, s in live.items()}
        own = reduce(lambda c, i: F.when(F.col("node") == i, F.col(live[i]["dim"])).otherwise(c), live, F.lit(None).cast("long"))
        inside = reduce(lambda c, i: F.when(F.col("node") == i, (F.col("own") >= live[i]["lo"]) & (F.col("own") < live[i]["hi"])).otherwise(c), live, F.lit(False))
        at = reduce(lambda c, i: F.when(F.col("node") == i, F.floor((F.col("own") - live[i]["lo"]) / F.lit(step[i]))).otherwise(c), live, F.lit(None))
        bins: dict[int, dict[int, tuple[int, int, int]]] = {}
        told = rows.select("node", "size", own.alias("own")).where(inside).select("node", "size", "own", at.cast("long").alias("bin"))
        for r in told.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("own").alias("a"), F.max("own").alias("z")).collect():
            bins.setdefault(r.node, {})[r.bin] = (r.w, r.a, r.z)
        for i in list(live):
            s, got, total = live[i], 0, bins[i]
            for b in sorted(total):
                if got + total[b][0] > s["want"]:
                    break
                got += total[b][0]
            else:
                b = max(total)
                got -= total[b][0]
            s["want"] -= got
            w, a, z = total[b]
            if a == z or w * 10_000 < s["all"]:  # one coordinate, or a light bin: split at its nearer edge
                s["lo"] = z + 1 if 2 * s["want"] > w else a
                del live[i]
            else:
                s["lo"], s["hi"] = a, z + 1
    return {i: (s["dim"], s["lo"]) for i, s in state.items()}


def kd_tree(rows: DataFrame, shards: int = SHARDS) -> tuple[dict[int, tuple[str, int]], dict[int, int]]:
    """Splits by node, and the first shard of each leaf. rows: as measured() gives them."""
    first = rows.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spread = {d: (first[f"lo_{d}"] or 0, first[f"hi_{d}"] or 0) for d in DIMS}
    splits: dict[int, tuple[str, int]] = {}
    level, leaves = {0: (shards, 0)}, {}
    while level:
        leaves |= {i: s for i, (k, s) in level.items() if k == 1}
        open_ = {i: k for i, (k, _) in level.items() if k > 1}
        new = _split_level(rows.withColumn("node", _node(splits)), open_, spread) if open_ else {}
        splits |= new
        leaves |= {i: s for i, (k, s) in level.items() if k > 1 and i not in new}  # no row is there
        level = {c: x for i, (k, s) in level.items() if i in new for c, x in ((2 * i + 1, (k // 2, s)), (2 * i + 2, (k - k // 2, s + k // 2)))}
    return splits, leaves


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot numbers a shard's rows from 0 without gaps."""
    rows = cut(measured(docs))
    splits, leaves = kd_tree(rows, shards)
    node = _node(splits)
    shard = reduce(lambda c, i: F.when(F.col("_node") == i, leaves[i]).otherwise(c), leaves, F.lit(0))
    placed = rows.withColumn("_node", node).select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    return gapless_rank(placed, ["shard"], ["doc_id", "text_crc32"], out="slot", salts=salts_for(rows.count() // shards))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kd_shards(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_kd_shards": op9_kd_shards}
ORACLE: dict[str, str] = {}
