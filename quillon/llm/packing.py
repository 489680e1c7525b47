"""Best-fit packing of token sequences by minimum bin slack.

Texts are encoded, ended with id 0 and cut into pieces of the capacity at most, the first being the shorter one. Only
the count of each length (as many numbers as the capacity) reaches the driver. There each bin is seeded with the
longest length left, and bitset subset-sum dynamic programming over the lengths left finds the fullest feasible
combination. The combination is taken as often as the counts allow, which gives what one bin at a time would. Pieces
of one length are alike, so each is placed by its rank among them; ranks are found without bringing a length's pieces
together in one task.

Null and empty texts have one token, the end id. Repeated rows and rows with a null doc_id are packed each; which of two
equal ones stands where is free. Of combinations that are as full the one that takes longer pieces first is taken. Extra
columns of any name are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.graph import gapless_rank, salts_for
from quillon.llm.tokens import END_ID, Encoder, default_vocabulary
from quillon.runtime import cut, ship, table

CAPACITY = 2048


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: how many}) that use up the counts."""
    left = {k: n for k, n in counts.items() if n > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("a length is beyond the capacity")
    lengths = sorted(left, reverse=True)
    plan = []
    full = (1 << (capacity + 1)) - 1
    while lengths:
        seed = lengths[0]
        room = capacity - seed
        left[seed] -= 1
        reach, steps = 1, []
        goal = 1 << room
        for k in lengths:
            if k > room:
                continue
            n, take = min(left[k], room // k), 1
            while n > 0 and not reach & goal:  # binary splitting of the multiplicity
                c = min(take, n)
                steps.append((k, c, reach))
                reach |= reach << (k * c) & full
                n, take = n - c, take * 2
            if reach & goal:
                break
        at = (reach & ((goal << 1) - 1)).bit_length() - 1
        used = {seed: 1}
        for k, c, before in reversed(steps):
            if not before >> at & 1:
                at -= k * c
                used[k] = used.get(k, 0) + c
        left[seed] += 1
        times = min(left[k] // c for k, c in used.items())
        for k, c in used.items():
            left[k] -= times * c
        lengths = [k for k in lengths if left[k]]
        plan.append((times, used))
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, how many in a bin, first bin, offset) in order of rank."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    base = 0
    for times, used in plan:
        off = 0
        for k, c in sorted(used.items(), reverse=True):
            out.setdefault(k, []).append((rank.get(k, 0), c, base, off))
            rank[k] = rank.get(k, 0) + times * c
            off += k * c
        base += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _cutter(path: str | None, capacity: int):
    def run(batches):
        enc = Encoder.of(path or default_vocabulary())
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                n, start, piece = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                view = memoryview(ids)
                while start < n:
                    for c, x in zip(cols, (doc, piece, start, size, zlib.crc32(view[4 * start : 4 * (start + size)])), strict=True):
                        c.append(x)
                    start, piece, size = start + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cutter(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _placer(where: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(length):
                rows, at = np.nonzero(length == k)[0], where[int(k)]
                p = at[np.searchsorted(at[:, 0], rank[rows], side="right") - 1]
                i = rank[rows] - p[:, 0]
                seq[rows] = p[:, 2] + i // p[:, 1]
                off[rows] = p[:, 3] + i % p[:, 1] * k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cutup = cut(pieces(docs, capacity, vocabulary))
    counts = {r.length: r["count"] for r in cutup.groupBy("length").count().collect()}  # capacity rows at most
    # lengths with many pieces are ranked by more tasks
    many = [F.lit(x) for k, n in counts.items() if salts_for(n) > salts_for(0) for x in (k, salts_for(n))]
    salts = F.coalesce(F.create_map(*many)[F.col("length")], F.lit(salts_for(0))) if many else salts_for(0)
    ranked = gapless_rank(cutup, ["length"], ["doc_id", "piece", "ids_crc32"], salts=salts)
    return ranked.mapInArrow(_placer(places(plan_bins(counts, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE: dict[str, str] = {}
