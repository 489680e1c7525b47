"""Whole programs: iterations until they settle, models to their scores, crawls, sorts with a check, stores and files.

Vectors and weights are whole numbers of thousandths or rounded after each step, so that sums do not depend on order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.functions import distances, registry
from quillon.functions.scalar import words
from quillon.operators import actions, aggregates, combine, joins, layout, position, sorting, transforms
from quillon.plans import pipelines
from quillon.plans.entry import catalogue
from quillon.runtime import cut, remove, shared_path, table
from quillon.sources import files, generate
from quillon.sources.store import Store

QUERIES, ORACLE, query = catalogue()

_V = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))"
_FAR = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: The largest step of a coordinate, in thousandths, at which centres count as settled; and the rounds at most.
SETTLED, ROUNDS = 10, 30
#: Groups of vectors whose pairs are a task: so many, of no fewer rows than that, and more beyond so many numbers in each.
GROUPS, FEWEST, NUMBERS = 16, 2048, 1 << 22
#: Words whose weights go to every node, at most.
COMMON = 300_000


@query(f"""
WITH RECURSIVE p AS (SELECT vec_id, label, {_V} AS v FROM embeddings),
it(i, cs, moved) AS (
  SELECT 0, list({{'k': k, 'v': v}} ORDER BY k), CAST(1000000 AS BIGINT) FROM (SELECT label AS k, arg_min(v, vec_id) AS v FROM p GROUP BY label)
  UNION ALL
  SELECT i + 1, list({{'k': k, 'v': v}} ORDER BY k), max(step) FROM (
    SELECT i, k, list(v ORDER BY d) AS v, max(abs(v - old)) AS step FROM (
      SELECT i, k, d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS v, any_value(old) AS old FROM (
        SELECT i, (best.c).k AS k, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x, unnest((best.c).v) AS old FROM (
          SELECT i, p.v AS v, arg_min({{'c': c}}, ({_FAR}, c.k)) AS best
          FROM p, (SELECT i, unnest(cs) AS c FROM it WHERE moved > {SETTLED} AND i < {ROUNDS}) GROUP BY i, p.vec_id, p.v))
      GROUP BY i, k, d) GROUP BY i, k) GROUP BY i)
SELECT CAST(i AS INTEGER) AS rounds, c.k AS label, c.v AS centre FROM (SELECT i, unnest(cs) AS c FROM it ORDER BY i DESC LIMIT (SELECT count(DISTINCT label) FROM embeddings))
""")
def kmeans_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres until none moves by more than a hundredth. Each round is one fold over the vectors, kept in memory; only
    the centres, a row for each label, come to the driver. A centre that no vector is nearest to goes."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v")).persist()
    centres = vectors.groupBy("label").agg(F.min_by("v", "vec_id").alias("v"))
    seed = F.struct(F.lit(None).cast("long").alias("d"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("array<bigint>").alias("v"))

    def nearer(best: Column, c: Column) -> Column:
        d = F.aggregate(F.zip_with(F.col("point"), c.v, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(best.d.isNull() | (d < best.d) | ((d == best.d) & (c.label < best.label)), F.struct(d.alias("d"), c.label.alias("label"), c.v.alias("v"))).otherwise(best)

    rows, rounds, moved = sorted((r.label, list(r.v)) for r in centres.collect()), 0, SETTLED + 1
    while moved > SETTLED and rounds < ROUNDS and rows:
        now = spark.createDataFrame(rows, "label int, v array<bigint>")
        told = joins.cross_join_fold_array(vectors.select(F.col("v").alias("point")), now, seed, nearer, "best")
        sums = told.select("best.label", "best.v", F.posexplode("point").alias("d", "x")).groupBy("label", "d").agg(F.floor(F.sum("x").cast("double") / F.count(F.lit(1))).cast("long").alias("x"), F.any_value(F.element_at("v", F.col("d") + 1)).alias("old"))
        got = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("v"), F.max(F.abs(F.col("x") - F.col("old"))).alias("step")).collect()
        rows, moved, rounds = sorted((r.label, list(r.v)) for r in got), max(r.step for r in got), rounds + 1
    vectors.unpersist()
    return spark.createDataFrame([(rounds, k, v) for k, v in rows], "rounds int, label int, centre array<bigint>")


@query(f"""
WITH p AS (SELECT vec_id, {_V} AS v FROM embeddings)
SELECT CAST(floor(sqrt({_FAR}) / 250) AS BIGINT) AS bucket, count(*) AS n FROM p JOIN p c ON p.vec_id < c.vec_id GROUP BY 1
""")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of vectors in buckets. Pairs are as many as the square of the rows; they are counted in
    blocks as they are made, by tasks that each hold two groups of vectors."""
    v = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    n, numbers = v.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    groups = max(1, min(GROUPS, -(-n // FEWEST)), -(-(numbers or 0) // NUMBERS))
    pairs = joins.pairs_fold(v, distances.bucket_pairs, distances.SCHEMA, groups)
    return aggregates.reduce_by_key(pairs, ["bucket"], n="sum(n)")


_EPOCH = """
e{k} AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM (
  SELECT r, round(any_value(w.a) - 0.5 * avg(d * x1), 6) AS a, round(any_value(w.b) - 0.5 * avg(d * x2), 6) AS b, round(any_value(w.c) - 0.5 * avg(d), 6) AS c
  FROM (SELECT r, x1, x2, y, 1 / (1 + exp(-(w.a * x1 + w.b * x2 + w.c))) - y AS d, w FROM rows, e{j} w) GROUP BY r))"""


@query(f"""
WITH rows AS (SELECT l_orderkey % 4 AS r, l_quantity / 50 AS x1, l_discount * 10 AS x2, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
e0 AS (SELECT 0.0 AS a, 0.0 AS b, 0.0 AS c), {", ".join(_EPOCH.format(k=k, j=k - 1) for k in range(1, 6))}
SELECT round(a, 5) AS quantity, round(b, 5) AS discount, round(c, 5) AS bias, (SELECT count(*) FROM rows) AS n FROM e5
""")
def sgd_epochs(spark: SparkSession, sf_dir: str, epochs: int = 5, rate: float = 0.5) -> DataFrame:
    """A logistic model by replicas: rows are kept in memory, each replica steps along its own gradient, and after each
    epoch the parameters are averaged. One fold by replica an epoch; a row for each replica comes to the driver."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("r"), (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    rows = layout.cache_in_memory(rows)
    w = (0.0, 0.0, 0.0)
    for _ in range(epochs):
        off = 1 / (1 + F.exp(-(F.lit(w[0]) * F.col("x1") + F.lit(w[1]) * F.col("x2") + F.lit(w[2])))) - F.col("y")
        steps = rows.withColumn("d", off).groupBy("r").agg(*[F.round(F.lit(v) - rate * F.avg(g), 6).alias(k) for k, v, g in zip("abc", w, (F.col("d") * F.col("x1"), F.col("d") * F.col("x2"), F.col("d")), strict=True)]).collect()
        w = tuple(sum(s[k] for s in steps) / len(steps) for k in "abc") if steps else w
    n = rows.count()
    rows.unpersist()
    return spark.createDataFrame([(*(round(x, 5) for x in w), n)], "quantity double, discount double, bias double, n long")


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents),
l AS (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL),
counts AS (SELECT quality, word, count(*) AS n FROM w JOIN l USING (doc_id) WHERE word <> '' GROUP BY ALL),
size AS (SELECT quality, count(*) AS docs FROM l WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) GROUP BY quality),
grid AS (SELECT word, q.quality, coalesce(n, 0) AS n, docs FROM (SELECT DISTINCT word FROM counts) CROSS JOIN (SELECT quality, docs FROM size) q LEFT JOIN counts c USING (word, quality)),
weight AS (SELECT word, CAST(round(1e6 * (ln((max(n) FILTER (quality = 1) + 1.0) / (max(docs) FILTER (quality = 1) + 2)) - ln((max(n) FILTER (quality = 0) + 1.0) / (max(docs) FILTER (quality = 0) + 2)))) AS BIGINT) AS v FROM grid GROUP BY word)
SELECT doc_id, CAST(sum(v) AS BIGINT) AS score, CAST(sum(v) > 0 AS INTEGER) AS told FROM w JOIN weight USING (word) GROUP BY doc_id
""")
def naive_bayes_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two map-reduce steps and a join: words by label, a weight for each word, and each document's sum of weights, in
    millionths. Weights of the most frequent words, COMMON at most, go to every node, where most of a document's words
    are summed as they are read; only the others are sent to meet their weights. No vocabulary comes to the driver."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    found = pipelines.document_words(docs)
    labels = layout.multicast(Dataset(table(spark, sf_dir, "labels")).choose(doc_id="doc_id", quality="quality").df.distinct())
    size = {r.quality: r.n for r in docs.select("doc_id").join(labels, "doc_id").distinct().groupBy("quality").agg(F.count(F.lit(1)).alias("n")).where("quality in (0, 1)").collect()}
    counts = cut(Dataset(found(docs.join(labels, "doc_id")), ["word"]).reduce_by_key(good="count_if(quality = 1)", bad="count_if(quality = 0)", n="count(1)").df)
    log = lambda n, q: F.log((F.col(n) + 1.0) / F.lit(size[q] + 2 if q in size else None))
    weight = counts.select("word", F.round(1e6 * (log("good", 1) - log("bad", 0))).cast("long").alias("v"), "n")
    least, held = 1 << 62, 0
    for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():
        held += r["count"]
        if held > COMMON:
            break
        least = 1 << r.power
    common, rare = F.broadcast(weight.where(F.col("n") >= least).drop("n")), weight.where(F.col("n") < least).drop("n")  # COMMON rows at most
    total = lambda d: d.groupBy("doc_id").agg(F.sum("v").alias("v"))
    scores = total(found(docs).join(common, "word")).unionByName(total(found(docs).join(common, "word", "left_anti").join(rare, "word")))
    scores = scores.groupBy("doc_id").agg(F.sum("v").alias("score"))
    return scores.select("doc_id", "score", (F.col("score") > 0).cast("int").alias("told"))


@query(f"""
WITH p AS (SELECT vec_id, label, {_V} AS v FROM embeddings), c AS (SELECT label AS col, arg_min(v, vec_id) AS v FROM p GROUP BY label)
SELECT p.vec_id AS row, c.col, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS value FROM p CROSS JOIN c
""")
def matrix_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of two matrices of cells (row, k, value) and (k, col, value): a join on k, products added up by cell."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    a = v.select(F.col("vec_id").alias("row"), F.posexplode("v").alias("k", "a"))
    b = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).select(F.col("label").alias("col"), F.posexplode("v").alias("k", "b"))
    return a.join(layout.multicast(b), "k").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


@query("""
WITH c AS (SELECT page_id, url, length(html) AS n, md5(html) AS digest FROM pages WHERE html IS NOT NULL)
SELECT 'stored' AS branch, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM c UNION ALL
SELECT 'links', count(*), CAST(sum(length(x)) AS BIGINT) FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM pages) UNION ALL
SELECT 'digests', count(DISTINCT digest), CAST(sum(length(digest)) AS BIGINT) FROM c
""")
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are fetched by coroutines (here from the table), in as many jobs as asked; two branches of what came are
    stored when the third is counted."""
    root = shared_path(spark, "crawl")
    store = Store(spark, root)
    pages = layout.reorg_with_degree(table(spark, sf_dir, "pages").select("page_id", "url", "html"), 6)

    async def fetch(row: dict) -> dict:
        if row["html"] is None:
            raise LookupError(row["url"])
        return {"page_id": row["page_id"], "html": row["html"], "digest": hashlib.md5(row["html"].encode()).hexdigest(), "job": row["part"]}

    got = transforms.async_mapi(pages, fetch, "page_id long, html string, digest string, job int", on_error="drop")
    with combine.Bypass(got, 3) as (one, two, three):
        whole, digests = combine.split(one, {"page_id": "page_id", "html": "html"}, {"digest": "digest"})
        store.lazy_save(whole.select("page_id", "html"), "pages")
        store.lazy_save(digests.select("digest"), "digests")
        links = transforms.choose(transforms.flat_map(two, F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), "link"), link="link")
        told = store.run(lambda: links.agg(F.count(F.lit(1)), F.sum(F.length("link"))).first())
        assert three.count() == store.length("pages")
    rows = [("links", *told), ("stored", *store.load("pages").agg(F.count(F.lit(1)), F.sum(F.length("html"))).first()), ("digests", *store.load("digests").agg(F.count_distinct("digest"), F.sum(F.length("digest"))).first())]
    remove(spark, root)
    return spark.createDataFrame(rows, "branch string, n long, chars long")


@query("SELECT count(*) AS n, true AS sorted, CAST(sum(l_orderkey * 7 + l_linenumber) AS BIGINT) AS checksum FROM lineitem")
def sort_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with ten-byte binary keys in one order, and a fold that looks at the order inside each partition and at the
    ends of neighbours; a row for each partition comes to the driver."""
    key = F.substring(F.unhex(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary"))), 1, 10)
    rows = cut(position.in_partition(sorting.total_sort(table(spark, sf_dir, "lineitem").select(key.alias("key"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("payload")), "key"), "part", "at"))
    before = F.lag("key").over(Window.partitionBy("part").orderBy("at"))
    told = rows.withColumn("ok", F.coalesce(before <= F.col("key"), F.lit(True))).groupBy("part").agg(F.bool_and("ok").alias("ok"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("payload").alias("c")).orderBy("part").collect()
    inside = all(r.ok for r in told) and all(bytes(a.hi) <= bytes(b.lo) for a, b in zip(told[:-1], told[1:], strict=True))
    return spark.createDataFrame([(sum(r.n for r in told), inside, sum(r.c for r in told))], "n long, sorted boolean, checksum long")


@query("SELECT CAST(l_orderkey % 16 AS INTEGER) AS part, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS payload FROM lineitem GROUP BY 1")
def repartition_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows to the partitions that a function names, counted where they arrive."""
    rows = layout.repartition_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), 16, "l_orderkey")
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("payload"))


_CENTRES = "c AS (SELECT label, arg_min(v, vec_id) AS v FROM p GROUP BY label)"


@query(f"""
WITH p AS (SELECT vec_id, label, {_V} AS v FROM embeddings), {_CENTRES},
a AS (SELECT vec_id, p.label, arg_min(c.label, ({_FAR}, c.label)) AS told FROM p CROSS JOIN c GROUP BY vec_id, p.label)
SELECT 'right' AS branch, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM a WHERE label = told UNION ALL SELECT 'wrong', count(*), CAST(coalesce(sum(vec_id), 0) AS BIGINT) FROM a WHERE label <> told
""")
def classified_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are classified once; two branches are split off and stored when the rows are counted."""
    root = shared_path(spark, "classes")
    store = Store(spark, root)
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("v"))
    centres = v.groupBy("label").agg(F.min_by("v", "vec_id").alias("w")).withColumnRenamed("label", "centre")
    far = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    told = joins.cross_join_fold(v, centres, ["vec_id", "label"], {"told": F.min_by("centre", F.struct(far, "centre"))})
    with combine.Bypass(told, 2) as (one, two):
        right, wrong = combine.split(one, {"vec_id": "if(label = told, vec_id, null)"}, {"vec_id": "if(label <> told, vec_id, null)"})
        store.lazy_save(transforms.choose(right, vec_id="vec_id"), "right")
        store.lazy_save(transforms.choose(wrong, vec_id="vec_id"), "wrong")
        n = store.run(two.count)
    rows = [(k, store.length(k), store.load(k).agg(F.coalesce(F.sum("vec_id"), F.lit(0))).first()[0]) for k in ("right", "wrong")]
    assert sum(r[1] for r in rows) == n
    remove(spark, root)
    return spark.createDataFrame(rows, "branch string, n long, ids long")


@query("SELECT 'd' || (page_id % 3) || '/p' || page_id || '.html' AS path, CAST(strlen(html) AS BIGINT) AS size, md5(html) AS digest FROM pages WHERE html IS NOT NULL")
def folder_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files out and in again: rows of bytes become a folder on the shared storage, and the folder rows."""
    root = shared_path(spark, "files")
    rows = table(spark, sf_dir, "pages").where("html is not null").select(F.concat(F.lit("d"), F.col("page_id") % 3, F.lit("/p"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    files.retrieve_folder(rows, root.removeprefix("file://"))
    out = cut(files.folder(spark, root, "*.html").select("path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest")))
    remove(spark, root)
    return out


@query("SELECT conv_id % 2 AS half, CAST(max(line) AS BIGINT) AS lines, count(*) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id % 2) AS line FROM conversations) GROUP BY 1")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as text and read back in splits, their lines numbered in each file."""
    root = shared_path(spark, "logs")
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 2).alias("half"), F.concat_ws(" ", "conv_id", "turn", F.translate("text", "\r\n", "  ")).alias("value"))
    rows.repartitionById(2, F.pmod("half", F.lit(2)).cast("int")).write.partitionBy("half").text(root)
    read = files.lines(spark, f"{root}/half=*/*")
    both = read.withColumn("half", F.element_at(F.split("content", " "), 1).cast("long") % 2)
    out = cut(both.groupBy("half").agg(F.max("line").alias("lines"), F.count(F.lit(1)).alias("n")))
    remove(spark, root)
    return out


@query("SELECT CAST(l_linenumber AS FLOAT) AS label, count(*) AS n, CAST(sum(l_orderkey % 1000) AS BIGINT) AS indices, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS vals FROM lineitem GROUP BY 1")
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse examples written and read."""
    root = shared_path(spark, "sparse")
    table(spark, sf_dir, "lineitem").select(F.concat_ws("", "l_linenumber", F.lit(" "), F.col("l_orderkey") % 1000, F.lit(":"), F.col("l_quantity").cast("long")).alias("value")).write.text(root)
    got = files.sparse_examples(spark, root)
    out = cut(got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("indices")[0].cast("long")).alias("indices"), F.sum(F.col("vals")[0].cast("long")).alias("vals")))
    remove(spark, root)
    return out


@query("SELECT n_nationkey AS k, lower(substr(n_name, 1, 1)) AS initial, CAST(count(c_custkey) AS BIGINT) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def service_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator for each initial asks a service for its names; the service is a named plan, asked once for each."""
    registry.register_plan("nations", lambda s, initial: table(s, sf_dir, "nation").where(F.lower(F.substring("n_name", 1, 1)) == initial).select("n_nationkey"))
    asked = {c: [r.n_nationkey for r in registry.stream_plan(spark, "nations", c)] for c in "abcdefghijklmnopqrstuvwxyz"}
    found = generate.source_i(spark, 26, lambda i: ((k, chr(97 + i)) for k in asked[chr(97 + i)]), "k int, initial string")
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("value"))
    return found.join(people, "k", "left").select("k", "initial", F.coalesce("value", F.lit(0)).alias("value"))


@query("SELECT CAST(i AS INTEGER) AS v FROM range(0, 40) r(i)")
def source_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same generator on every node."""
    return generate.source(spark, lambda: range(40), "v int").distinct()


@query("SELECT CAST(i AS INTEGER) AS i, CAST(i * 10 + j AS INTEGER) AS v FROM range(0, 3) a(i), range(0, 10) b(j)")
def source_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators of every node by their number there."""
    return generate.source_n(spark, 3, lambda i: ((i, i * 10 + j) for j in range(10)), "i int, v int").distinct()


_PLACES = "SELECT CAST(i AS INTEGER) AS part, j AS idx, CAST(i * 7 + j AS INTEGER) AS v, CAST((i * 7 + j) * (i + 1) + j AS BIGINT) AS w FROM range(0, 4) a(i), range(0, 25) b(j)"


def _seven(spark: SparkSession) -> DataFrame:
    return generate.source_i(spark, 4, lambda i: (i * 7 + j for j in range(25)), "v int")


def _placed(r: dict) -> dict:
    return {"part": r["part"], "idx": r["idx"], "v": r["v"], "w": r["v"] * (r["part"] + 1) + r["idx"]}


@query(_PLACES)
def async_mapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    async def f(r: dict) -> dict:
        return _placed(r)

    return transforms.async_mapi(_seven(spark), f, "part int, idx long, v int, w long")


@query(_PLACES)
def parallel_mapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.parallel_mapi(_seven(spark), _placed, "part int, idx long, v int, w long")


@query("SELECT CAST(p AS INTEGER) AS p, CAST(j AS INTEGER) AS idx FROM range(0, 5) a(p), range(0, 11) b(j)")
def init_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.init_s(spark, 11, 5)


@query("SELECT CAST(p AS INTEGER) AS p, CAST(j AS INTEGER) AS idx FROM range(0, 4) a(p), range(0, 9) b(j)")
def init_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many partitions for each node, of which those of the first are told."""
    return generate.init_n(spark, 4, 9).where("p < 4")


@query("SELECT CAST(i AS INTEGER) AS k FROM range(0, 41) r(i)")
def distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.distribute(spark, list(range(41)), "k int")


@query("SELECT CAST(i AS INTEGER) AS k, CAST(i * i AS INTEGER) AS v FROM range(1, 17) r(i)")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the client stored and loaded, under a version of one's own."""
    root = shared_path(spark, "rows")
    store = Store(spark, root)
    store.store([(i, i * i) for i in range(1, 17)], "k int, v int", "squares", version=0, partitions=3)
    out = cut(store.load("squares", 0))
    remove(spark, root)
    return out


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def save_monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What meets a predicate, from what was saved."""
    root = shared_path(spark, "rows")
    rows = [tuple(r) for r in Store(spark, root).save_with_monitor(table(spark, sf_dir, "region"), "regions", "r_regionkey > 1")]
    remove(spark, root)
    return spark.createDataFrame(rows, "r_regionkey int, r_name string")


@query("SELECT count(*) AS n, true AS some FROM nation")
def stored_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "rows")
    store = Store(spark, root)
    store.lazy_save(table(spark, sf_dir, "nation"), "nations")
    store.flush()
    told = (store.length("nations"), store.size_in_bytes("nations") > 0)
    remove(spark, root)
    return spark.createDataFrame([told], "n long, some boolean")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def cache_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = layout.cache_on_disk(table(spark, sf_dir, "orders").select("o_orderpriority"))
    rows = [tuple(r) for r in kept.groupBy("o_orderpriority").count().collect()]
    kept.unpersist()
    return spark.createDataFrame(rows, "o_orderpriority string, n long")


@query("SELECT count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation")
def iter_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A side effect for each row, told by accumulators."""
    rows, keys = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def effect(r) -> None:
        rows.add(1)
        keys.add(r.n_nationkey)

    aggregates.iterate(table(spark, sf_dir, "nation"), effect)
    return spark.createDataFrame([(rows.value, keys.value)], "rows long, keys long")


@query("SELECT n_nationkey AS seq, n_name AS name FROM nation")
def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they come to the client, one by one."""
    got: list[tuple] = []
    actions.local_iter(table(spark, sf_dir, "nation"), lambda r: got.append((r.n_nationkey, r.n_name)))
    assert len(got) == sum(1 for _ in actions.to_seq(table(spark, sf_dir, "nation")))
    return spark.createDataFrame(got, "seq int, name string")


@query("SELECT CAST(10 AS BIGINT) AS taken, CAST(42 AS BIGINT) AS one, CAST(1 AS BIGINT) AS every")
def take_and_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, a function in one remote task, and one in each of several."""
    ran = spark.sparkContext.accumulator(0)
    registry.register_call("answer", lambda x: x * 6)
    one = registry.call(spark, "answer", 7)
    actions.execute(spark, lambda: ran.add(1), 5)
    return spark.createDataFrame([(len(sorting.take(table(spark, sf_dir, "orders"), 10)), one, ran.value // 5)], "taken long, one long, every long")


@query("SELECT p_partkey, p_name FROM part")
def rows_split_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one row, then of whole partitions: the rows stay."""
    return layout.rows_merge_all(layout.rows_split(table(spark, sf_dir, "part").select("p_partkey", "p_name")))
