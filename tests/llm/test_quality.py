import numpy as np
from pyspark.sql import functions as F

from quillon.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_scores_match_a_plain_discriminant():
    rng = np.random.default_rng(1)
    d = Q.N_MEASURES
    x = {0: rng.normal(size=(200, d)) * 2 + 1, 1: rng.normal(size=(300, d))}
    sums = {k: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for k, v in x.items()}
    m = Q.Discriminant(sums)
    every = np.concatenate([x[0], x[1]])
    mean, sd = every.mean(0), every.std(0)
    z = {k: (v - mean) / sd for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = (200 * cov[0] + 300 * cov[1]) / 500
    pooled = 0.95 * pooled + 0.05 * np.trace(pooled) / d * np.eye(d)
    log = {}
    q = (every[:50] - mean) / sd
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * pooled
        r = q - z[k].mean(0)
        log[k] = np.log(len(z[k]) / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", r, np.linalg.inv(c), r)
    assert np.allclose(m.score(every[:50]), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-9)


def test_query_against_plain_sums(spark, docs_of):
    """Repeated and null ids, unknown labels and clashing names; the whole query by numpy."""
    rng = np.random.default_rng(3)
    words = ["good", "Bad!!", "x1", "the", "of", "ein", "|||"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words, size=rng.integers(0, 60)))) for i in range(300)] + [(5, "other text"), (6, None)]
    truth = [(i, int(i % 3 == 0)) for i in range(1, 250, 2)] + [(10**6, 1), (None, 0), (7, 5)]
    x = np.array([Q.measure(t) for _, t in rows])
    y = {}
    for d, k in truth:
        if k in (0, 1):
            y.setdefault(d, []).append(k)
    pick = {k: np.array([x[i] for i, (d, _) in enumerate(rows) for v in (y.get(d, []) if d is not None else []) if v == k]) for k in (0, 1)}
    every = np.concatenate([pick[0], pick[1]])
    mean, sd = every.mean(0), every.std(0)
    sd[sd < 1e-5] = 1
    log, cov = {}, {k: np.cov(((v - mean) / sd).T, bias=True) for k, v in pick.items()}
    pooled = sum(len(pick[k]) * cov[k] for k in cov) / len(every)
    pooled = 0.95 * pooled + 0.05 * np.trace(pooled) / len(mean) * np.eye(len(mean))
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * pooled
        r = (x - mean) / sd - ((pick[k] - mean) / sd).mean(0)
        log[k] = np.log(len(pick[k]) / len(every)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", r, np.linalg.inv(c), r)
    want = sorted((d or 0, round(float(s), 6)) for (d, _), s in zip(rows, 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), strict=True))
    labels = spark.createDataFrame(truth, "doc_id long, y int")
    got = Q.quality(docs_of(rows).selectExpr("*", "1 as x", "2 as y", "3 as score"), labels).collect()
    assert np.allclose([(d, s) for d, s in sorted((r.doc_id or 0, round(r.score, 6)) for r in got)], want, atol=2e-6)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op10_quality_qda(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_edges(spark, docs_of):
    docs = docs_of([None, "", " ", "a", "x" * 100_000, "same same " * 5000, "good words here", "good words here"])
    labels = spark.createDataFrame([(5, 0), (6, 1), (3, 1), (4, 0), (4, 7), (None, 1)], "doc_id long, y int")
    got = Q.quality(docs.selectExpr("*", "1 as x", "2 as y"), labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.quality(docs, labels.where(F.lit(False))).collect()} == {0.5}
    assert Q.quality(docs_of([]), labels).count() == 0
