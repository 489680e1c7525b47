"""Document quality by a regularised quadratic discriminant.

Each text is measured once (shares of character kinds, words, repeats; on log scales). Class sums and cross products
are added up by Spark, so a few hundred numbers reach the driver. Class covariances are shrunk towards the pooled one
and the pooled one towards a multiple of the identity. A score is the logistic of the difference of log densities:
Mahalanobis distances by Cholesky factors that are computed once, log determinants and class shares.

Null and empty texts have the measures of an empty text. Without labelled rows of both classes the score is the
learned class's share, or 0.5. Labels other than 0 and 1 and those of unknown or null doc_ids are left out; rows with the
same doc_id are scored each by its own text, and learned from each. Extra columns of any name are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import cut, ship, table

TO_POOLED, TO_ROUND = 0.2, 0.05
_KIND = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b, 0] = 65 <= _b <= 90
    _KIND[_b, 1] = 48 <= _b <= 57
    _KIND[_b, 2] = _c in "!?"
    _KIND[_b, 3] = _c in "|<>{}[]#@&=*+_~^\\/"
    _KIND[_b, 4] = _c in ".,;:"
    _KIND[_b, 5] = _b == 10
    _KIND[_b, 6] = _b >= 128
    _KIND[_b, 7] = _c in " \t"
    _KIND[_b, 8] = 97 <= _b <= 122
N_MEASURES = 17


def measure(text: str | None) -> list[float]:
    """The measures of a whole text; all are finite."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND) / max(1, n)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    m = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    longest = max(map(len, words), default=0)
    return [
        *np.log(shares + 0.002).tolist(),
        np.log1p(n),
        np.log1p(len(words)),
        np.log((n - len(words)) / m + 1),
        np.log(distinct / m + 0.01),
        np.log(again / m + 0.002),
        np.log(pairs / m + 0.01),
        np.log(len(set(lines)) / max(1, len(lines)) + 0.01),
        np.log1p(longest),
    ]


def _measures(batches):
    for b in batches:
        for at in range(0, b.num_rows, 500):
            texts = b.column(1).slice(at, 500).to_pylist()
            flat = np.array([measure(t) for t in texts]).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_MEASURES), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), lists], names=["doc_id", "x"])


def measures(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measures, "doc_id long, x array<double>")


def _sums(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        y = b.column(0).to_numpy()
        x = np.array(b.column(1).to_pylist()).reshape(len(y), -1)
        for k in np.unique(y):
            z = np.column_stack([np.ones((y == k).sum()), x[y == k]])
            total[int(k)] = total.get(int(k), 0) + z.T @ z
    for k, t in total.items():
        n = t.size
        yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(t.ravel())], names=["y", "at", "v"])


class Discriminant:
    def __init__(self, sums: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_round: float = TO_ROUND):
        """sums: for each class the cross products of (1, measures)."""
        n = {k: s[0, 0] for k, s in sums.items() if s[0, 0] > 0}
        self.constant = None
        if len(n) < 2:
            self.constant = float(next(iter(n))) if n else 0.5
            return
        total = sum(sums[k] for k in n)
        self.mean = total[0, 1:] / total[0, 0]
        self.scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - self.mean**2, 1e-12))
        self.scale[self.scale < 1e-5] = 1
        d = len(self.mean)
        mu, cov = {}, {}
        for k in n:
            m = sums[k][0, 1:] / n[k]
            cov[k] = (sums[k][1:, 1:] / n[k] - np.outer(m, m)) / np.outer(self.scale, self.scale)
            mu[k] = (m - self.mean) / self.scale
        pooled = sum(n[k] * cov[k] for k in n) / sum(n.values())
        pooled = (1 - to_round) * pooled + to_round * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        self.parts = {}
        for k in n:
            chol = np.linalg.cholesky((1 - to_pooled) * cov[k] + to_pooled * pooled)
            self.parts[k] = (mu[k], np.linalg.inv(chol), np.log(np.diag(chol)).sum(), np.log(n[k] / sum(n.values())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.mean) / self.scale
        density = {k: prior - half - 0.5 * (((z - mu) @ inv.T) ** 2).sum(1) for k, (mu, inv, half, prior) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """labels: (doc_id, y) with y 0 or 1; other values are left out."""
    pairs = measured.join(labels.where("y in (0, 1)"), "doc_id").select(F.col("y").cast("int"), "x")
    rows = pairs.mapInArrow(_sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    d = N_MEASURES + 1
    sums = {k: np.zeros(d * d) for k in {r.y for r in rows}}
    for r in rows:
        sums[r.y][r["at"]] = r.v
    return Discriminant({k: s.reshape(d, d) for k, s in sums.items()})


def _scores(model: Discriminant):
    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document; learns from the labels given."""
    measured = cut(measures(docs))
    return measured.mapInArrow(_scores(fit(measured, labels)), "doc_id long, score double")


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("y"))
    got = quality(table(spark, sf_dir, "documents"), labels)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality_qda": op10_quality_qda}
ORACLE: dict[str, str] = {}
