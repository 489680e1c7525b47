import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing as P
from quillon.llm import token_orc as O
from quillon.llm.tokens import Encoder, default_vocabulary

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "a\n\n  b c\t d", "  x  y", "x  y", "a \x1c b", "l'été  d'ici 's 've", "ab1 23,,  !! \r\n z", "😀 é́ 中文 字", "x" * 9000, "<|endoftext|> y"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 0]


def texts():
    rng = random.Random(3)
    parts = [" ", " ", " ", "  ", "\n", "\t", "the", "Haus", "é", "1", ",", "'s", " ", " ", "ß", "\x1d", "\x85"]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]


def test_words_give_the_ids_of_whole_texts(whole):
    enc = Encoder(default_vocabulary())
    t = texts()
    for x, ids in zip(t, enc.encode(t), strict=True):
        assert [*np.frombuffer(ids, "<u4"), 0] == whole(x), repr(x)


def test_orc_round_trip(docs_of, spark, whole, tmp_path):
    t = texts()[:400]
    rows = [(7 * i % 1009, x) for i, x in enumerate(t)]
    docs = docs_of(rows).selectExpr("*", "1 as range", "'x' as ids").repartition(5)
    O.write_tokens(docs, str(tmp_path / "o"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in O.read_index(spark, str(tmp_path / "o")).collect()}
    at = 0
    for i, x in sorted(rows):
        ids = whole(x)
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert O.lookup(spark, str(tmp_path / "o"), 7).first().n_tokens == len(whole(t[1]))
    O.write_tokens(docs_of([]), str(tmp_path / "e"))
    assert O.read_index(spark, str(tmp_path / "e")).count() == 0


def test_pack_is_a_packing(docs_of, whole):
    rng = random.Random(4)
    t = [*ODD, *[" ".join(rng.choices(["the", "of", "x9", "Haus"], k=rng.choice([3, 40, 500, 2500, 7000]))) for _ in range(60)], *["same text"] * 50]
    rows = [*enumerate(t), (3, t[3])]
    got = P.pack(docs_of(rows)).collect()
    seqs = {}
    for r in got:
        ids = whole(t[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert r.length <= 2048 and (r.piece == 0 or r.length == 2048)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    total = sum(len(whole(t[i])) for i, _ in rows)
    assert sum(r.length for r in got) == total
    assert len(seqs) <= -(-total // 2048) + 1
    assert P.pack(docs_of([])).count() == 0


def test_ties_null_ids_and_clashing_names(docs_of, whole):
    rows = [(None, "a b"), (None, "a b"), (None, None), (1, "a b"), (1, "c"), (1, "c"), (2, "")]
    docs = docs_of(rows).selectExpr("*", "1 as piece", "2 as length", "3 as rank", "4 as _salt", "5 as range", "6 as row")
    got = P.pack(docs).collect()
    assert len(got) == len(rows) and len({r.sequence_id for r in got}) == 1
    at = 0
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == at
        at += r.length


def test_orc_ties_and_null_ids(docs_of, spark, whole, tmp_path):
    rows = [(None, "a b"), (None, None), (5, "one"), (5, "two words"), (5, "one"), (2, "x " * 50), (9, "")]
    O.write_tokens(docs_of(rows).selectExpr("*", "1 as row", "2 as n_tokens"), str(tmp_path / "o"))
    got = sorted(O.read_index(spark, str(tmp_path / "o")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 5, 5, 5, 9]
    at = 0
    for r in got:  # the places are those of the rows in the file
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array(whole(t), "<u4").tobytes())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((d or 0, crc(t)) for d, t in rows)
    read = [(r.doc_id, r.ids) for r in spark.read.orc(str(tmp_path / "o")).orderBy("range", "row").collect()]
    assert [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in read] == [r.ids_crc32 for r in got]


def test_orc_files_have_run_lengths_indexes_and_bloom_filters(docs_of, spark, tmp_path):
    path = str(tmp_path / "o")
    O.write_tokens(docs_of([(3 * i, "a b c") for i in range(6000)]).coalesce(1), path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc.OrcFile
    encodings, kinds, rows = set(), set(), 0
    for f in sorted((tmp_path / "o").glob("*.orc")):
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), orc.readerOptions(conf))
        assert reader.getRowIndexStride() == O.STRIDE
        records = reader.rows()
        for stripe in reader.getStripes():
            footer = records.readStripeFooter(stripe)
            encodings |= {str(footer.getColumns(k).getKind()) for k in range(footer.getColumnsCount())}
            kinds |= {(str(x.getKind()), x.getColumn()) for x in footer.getStreamsList()}
            rows += stripe.getNumberOfRows()
        records.close()
    assert rows == 6000 and "DIRECT_V2" in encodings
    of = {k: {c for kind, c in kinds if kind == k} for k in ("ROW_INDEX", "BLOOM_FILTER_UTF8")}
    assert 3 in of["ROW_INDEX"] and of["BLOOM_FILTER_UTF8"] == {3}  # columns: root, range, row, doc_id
    for doc, n in ((3 * 4321, 1), (3 * 4321 + 1, 0)):
        found = O.lookup(spark, path, doc)
        assert len(found.collect()) == n
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() <= n * O.STRIDE  # other row groups are not read


def test_plan_is_as_full_as_can_be():
    """Each bin against all sums of what is left, and the whole against one bin at a time."""
    rng = random.Random(8)
    for case in range(60):
        capacity = rng.choice([10, 50, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        left = dict(counts)
        for times, used in P.plan_bins(counts, capacity):
            for _ in range(times):
                seed = max(k for k, n in left.items() if n)
                sums = {seed}
                for k, n in left.items():
                    for _ in range(n - (k == seed)):
                        sums |= {s + k for s in sums if s + k <= capacity}
                assert used.get(seed) and sum(k * c for k, c in used.items()) == max(sums), case
                for k, c in used.items():
                    left[k] -= c
                    assert left[k] >= 0
        assert not any(left.values())


def test_plan_uses_all_and_fits():
    rng = random.Random(5)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(30)}
        plan = P.plan_bins(counts, 100)
        used = {}
        for times, u in plan:
            assert sum(k * c for k, c in u.items()) <= 100
            for k, c in u.items():
                used[k] = used.get(k, 0) + times * c
        assert used == counts
    assert P.plan_bins({}) == []
    assert P.plan_bins({60: 2, 40: 1, 35: 1, 5: 1}, 100) == [(1, {60: 1, 40: 1}), (1, {60: 1, 35: 1, 5: 1})]
