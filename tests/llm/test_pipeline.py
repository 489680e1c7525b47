"""All five stages one after the other: nulls, ties, repeated rows with unlike texts, empty tables, clashing names."""

import random

import corpus_pipeline as C
import pytest

from quillon.llm.decontam import words_of
from quillon.runtime import shared_dir

#: Names that operators use inside.
NAMES = ["batch", "deal", "salts", "rest", "key", "data", "_deal", "_salts", "_own_batch", "_bad", "_keep", "_least", "_text", "_row", "_doc", "_maybe", "_key", "node", "class", "component", "fp", "bucket", "n", "first", "spans", "items", "score", "lang_pred", "piece", "length", "rank", "_salt"]
SYLLABLES = {"de": ["der", "die", "haus", "straße", "über", "nicht", "und", "ein", "schön"], "en": ["the", "house", "which", "over", "not", "and", "with", "wood", "thing"]}


def tables(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(NAMES)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    text = lambda lang, n: " ".join(rng.choice(SYLLABLES[lang]) + rng.choice(["", "", "", ".", str(rng.randint(0, 999))]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(30, 90)), lang, "web", 0) for i in range(120) for lang in [rng.choice(["de", "en"])]]
    passage = text("en", 40)
    item = " ".join(f"question{i} the" for i in range(12))
    odd = [(None, None), (None, "12 34"), (None, text("de", 50)), (7, text("en", 50)), (7, item), (200, ""), (201, "!!"), (202, rows[3][1]), (203, rows[3][1] + " more"), (None, rows[3][1])]
    odd += [(204, text("en", 30) + "\n" + passage), (205, text("en", 30) + "\n" + passage), (206, text("en", 900) + " " + item), (207, item.upper())]
    return [*rows, *((i, t, "en" if t else None, None, 0) for i, t in odd)], passage, item


def test_stages(spark, tmp_path, corpus):
    rows, passage, item = corpus
    tables(spark, tmp_path, rows, [(1, item), (2, None), (3, "")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
        assert {tuple(r[c] for c in NAMES) for r in docs.select(*[f"`{c}`" for c in NAMES]).collect()} <= {tuple(range(len(NAMES)))}
    told, alone, cut, clean = kept
    given = [(r[0], r[1]) for r in rows]
    assert set(given) - set(told) == {(None, None), (None, "12 34"), (200, ""), (201, "!!")}
    # one of the exact and near copies stays, and rows of one id with unlike texts are told each
    assert set(told) - set(alone) == {(202, rows[3][1]), (203, rows[3][1] + " more"), (None, rows[3][1]), (207, item.upper())}
    texts = dict(x for x in cut if x[0] not in (None, 7))
    assert len(cut) == len(alone) and passage in texts[204] and passage not in texts[205]
    left = set(cut) - set(clean)
    assert all(words_of(item)[0] in words_of(t) for _, t in left) and {d for d, _ in left} >= {7} and not any(item in t for _, t in clean)
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in clean}


def test_run_removes_its_tables_and_takes_empty_ones(spark, tmp_path, corpus):
    rows, _, item = corpus
    here = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillon")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda: {str(x.getPath()) for x in fs.listStatus(here)} if fs.exists(here) else set()
    before = there()
    for name, some, items in (("a", rows[:60], []), ("b", [], [(1, item)])):
        tables(spark, tmp_path / name, some, items)
        out = C.run(spark, str(tmp_path / name))
        assert (out.count() > 0) == bool(some)
    assert there() <= before
