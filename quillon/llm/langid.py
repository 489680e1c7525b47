"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's likelihood is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The probabilities
are fitted by expectation maximisation on word counts of labelled training documents: forward and backward sums give
expected piece counts, Spark adds them up, and languages times vocabulary numbers reach the driver.

The sums are scaled every few letters, so words of any length are taken whole, with all pieces of the vocabulary.

The fit takes ``TRAIN_DOCS`` documents of each language at most, picked by a hash of doc_id; scores cover every whole
text. Letters are characters of the category L. Null texts and texts without a letter are ``und`` with score 0, and so is
everything where nothing could be learned. Letters outside the vocabulary cost the same in every language. Of languages
with the same likelihood the first by name is told. Repeated rows are scored each, with a null doc_id too; extra columns
of any name are ignored, or kept by the stage; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import claim, give_back, remembers
from quillon.runtime import ship, table

TRAIN_DOCS = 2000
ROUNDS = 2
#: Letters between two scalings of the sums.
STEP = 8
#: Letters times languages that are in memory at once; one longer word is taken alone.
LETTERS = 600_000
#: A word of more letters is taken in steps of so many, the sums being carried on; the fit leaves such words out.
SEGMENT = 20_000
CACHE_WORDS = 500_000
#: A document stays in the pipeline if its language is told with this posterior at least.
KEEP = 0.5
ALPHA = 0.05
UNKNOWN = 1e-6
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LETTERS = re.compile(r"[^\W\d_]+")
_VOCAB: dict[str | None, "Pieces"] = {}
_SCORERS: dict[str, "Scorer"] = {}


def _forget() -> None:
    _VOCAB.clear()
    _SCORERS.clear()


remembers("langid", _forget)


def vocabulary(path: str | None = None) -> Pieces:
    """Pieces of letters with their ids; a word begins with the mark of a space."""
    if path not in _VOCAB:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
        own = sorted({p for p in pieces if p.lower() == p and p.lstrip("▁").isalpha()})
        _VOCAB[path] = Pieces({p: i + 1 for i, p in enumerate(own)})  # 0 stands for any other letter
    return _VOCAB[path]


class Pieces(dict):
    """Ids of pieces, and for each length the sorted 64-bit hashes by which whole arrays are looked up."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        self.tables = []
        self.longest = max(map(len, ids), default=1)
        for k in range(1, self.longest + 1):
            own = [(p, i) for p, i in ids.items() if len(p) == k]
            h = np.zeros(len(own), dtype=np.uint64)
            for c in _codes("".join(p for p, _ in own)).reshape(-1, k).T:
                h = h * _BASE + c
            order = np.argsort(h)
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[_top(h)] = True
            self.tables.append((maybe, h[order], np.array([i for _, i in own], dtype=np.int64)[order]))

    def find(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of pieces of k letters, and the pieces."""
        maybe, known, ids = self.tables[k - 1]
        at = np.flatnonzero(maybe[_top(h)])
        place = np.searchsorted(known, h[at])
        place[place == len(known)] = 0
        hit = known[place] == h[at] if len(known) else np.zeros(0, dtype=bool)
        return at[hit], ids[place[hit]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _top(h: np.ndarray) -> np.ndarray:
    return (h * _SPREAD) >> np.uint64(48)


def lattice(words: list[str], vocab: dict[str, int]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each (end, length), in order, the words that have a piece there, and the piece."""
    vocab = vocab if isinstance(vocab, Pieces) else Pieces(vocab)
    size = np.array([len(w) for w in words], dtype=np.int64)
    codes = _codes("".join(words))
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - (np.cumsum(size) - size)[owner]
    room = size[owner] - at
    live, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
    keys, owners, pieces = [], [], []
    for k in range(1, vocab.longest + 1):
        keep = room[live] >= k
        live, h = live[keep], h[keep]
        h = h * _BASE + codes[live + k - 1]
        hit, ids = vocab.find(k, h)
        if k == 1:  # a letter outside the vocabulary is piece 0
            every = np.zeros(len(live), dtype=np.int64)
            every[hit] = ids
            hit, ids = np.arange(len(live)), every
        keys.append((at[live[hit]] + k) << 8 | k)
        owners.append(owner[live[hit]])
        pieces.append(ids)
    key, own, piece = (np.concatenate(x) for x in (keys, owners, pieces))
    order = np.argsort(key, kind="stable")
    edges, first = np.unique(key[order], return_index=True)
    return {(int(e) >> 8, int(e) & 255): (own[o], piece[o]) for e, o in zip(edges, np.split(order, first[1:]), strict=True)} if len(edges) else {}


def _scaled(alpha: np.ndarray, scale: np.ndarray, now: np.ndarray, lo: int, hi: int) -> None:
    """Make the greatest of the sums at the places lo..hi-1 one for each word and language; ``now`` is their log scale."""
    top = alpha[lo:hi].max(0)
    top[top == 0] = 1
    alpha[lo:hi] /= top
    now += np.log(top)
    scale[lo:hi] = now


def forward(words: list[str], edges: dict, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale)[position, word, language]: alpha * exp(scale) is the sum over segmentations up to each position."""
    alpha = np.zeros((max(map(len, words), default=0) + 1, len(words), probs.shape[1]))
    scale, now = np.zeros_like(alpha), np.zeros(alpha.shape[1:])
    alpha[0] = 1
    longest, done = max((k for _, k in edges), default=1), 0
    for (j, k), (w, p) in edges.items():
        if j > done:
            if done and done % STEP == 0:
                _scaled(alpha, scale, now, max(0, done - longest + 1), done + 1)
            done, scale[j] = j, now
        alpha[j, w] += alpha[j - k, w] * probs[p]
    return alpha, scale


def _backward(words: list[str], edges: dict, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the ends of the words on."""
    beta = np.zeros((max(map(len, words), default=0) + 1, len(words), probs.shape[1]))
    scale, now = np.zeros_like(beta), np.zeros(beta.shape[1:])
    beta[[len(w) for w in words], np.arange(len(words))] = 1
    longest, done = max((k for _, k in edges), default=1), len(beta)
    # by start, the later ones first: what a start needs is whole then
    for (j, k), (w, p) in sorted(edges.items(), key=lambda e: e[0][1] - e[0][0]):
        if j - k < done:
            if done < len(beta) and done % STEP == 0:
                _scaled(beta, scale, now, done, min(len(beta), done + longest))
            done = j - k
            scale[done] = now
        beta[j - k, w] += beta[j, w] * probs[p]
    return beta, scale


def _chunks(words: list[str], languages: int):
    """Places of words of like length, of bounded letters together."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    held: list[int] = []
    for i in order:
        if held and ((len(held) + 1) * (len(words[i]) + 1) * max(1, languages) > LETTERS or len(words[i]) > SEGMENT):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def _long(word: str, vocab: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log-likelihood of a very long word, a segment being in memory at a time."""
    now, tail, at = np.zeros(probs.shape[1]), np.ones((1, probs.shape[1])), 0
    while at < len(word):
        base, done = at - len(tail) + 1, len(tail) - 1
        own = word[base : at + SEGMENT]
        alpha = np.zeros((len(own) + 1, probs.shape[1]))
        alpha[: len(tail)] = tail
        for (j, k), (_, p) in lattice([own], vocab).items():
            if j < len(tail):
                continue
            if j > done:
                if done % STEP == 0:
                    top = alpha[max(0, done - vocab.longest + 1) : done + 1].max(0)
                    alpha[max(0, done - vocab.longest + 1) : done + 1] /= top
                    now += np.log(top)
                done = j
            alpha[j] += alpha[j - k] * probs[p[0]]
        tail, at = alpha[-vocab.longest :], base + len(own)
    return np.log(tail[-1]) + now


def likelihoods(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    vocab = vocab if isinstance(vocab, Pieces) else Pieces(vocab)
    out = np.zeros((len(words), probs.shape[1]))
    for some in _chunks(words, probs.shape[1]):
        own = [words[i] for i in some]
        if len(own) == 1 and len(own[0]) > SEGMENT:
            out[some[0]] = _long(own[0], vocab, probs)
            continue
        alpha, scale = forward(own, lattice(own, vocab), probs)
        end = ([len(w) for w in own], np.arange(len(own)))
        out[some] = np.log(alpha[end]) + scale[end]
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, words being weighted; probs has one column."""
    out = np.zeros(len(probs))
    for some in _chunks(words, 2):
        own, n = [words[i] for i in some], counts[some]
        if len(own[0]) > SEGMENT:
            continue
        edges = lattice(own, vocab)
        (alpha, up), (beta, down) = forward(own, edges, probs), _backward(own, edges, probs)
        end = ([len(w) for w in own], np.arange(len(own)))
        total, level = alpha[end][:, 0], up[end][:, 0]
        for (j, k), (w, p) in edges.items():
            share = alpha[j - k, w, 0] * probs[p, 0] * beta[j, w, 0] / total[w]
            np.add.at(out, p, n[w] * share * np.exp(up[j - k, w, 0] + down[j, w, 0] - level[w]))
    return out


def parts_of(word: str) -> list[str]:
    """The letter runs of a word in lower case, each with the mark of a space."""
    if word.isalpha():
        return ["▁" + word]
    runs = _LETTERS.findall(word)
    return ["▁" + x for run in runs for x in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


class Scorer:
    """Sums of words' log-likelihoods, with a memory of words."""

    def __init__(self, langs: list[str], probs: np.ndarray, path: str | None):
        self.langs, self.probs, self.vocab = langs, probs, vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1), dtype=np.float64)
        self.known: dict[str, int] = {}
        self.parts = np.zeros((1024, len(self.langs)), dtype=np.float64)

    @staticmethod
    def _room(rows: np.ndarray, need: int) -> np.ndarray:
        return rows if need <= len(rows) else np.concatenate([rows, np.zeros((max(len(rows), need - len(rows)), rows.shape[1]))])

    def _learn_parts(self, fresh: list[str]) -> None:
        n = len(self.known)
        self.parts = self._room(self.parts, n + len(fresh))
        self.parts[n : n + len(fresh)] = likelihoods(fresh, self.vocab, self.probs)
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def _learn(self, words: list[str]) -> None:
        cuts = [parts_of(w) for w in words]
        self._learn_parts(sorted({p for c in cuts for p in c}.difference(self.known)))
        n = len(self.at)
        self.rows = self._room(self.rows, n + len(words))
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        size = np.array([len(c) for c in cuts], dtype=np.int64)
        has = np.flatnonzero(size)
        if len(has):
            ll = self.parts[np.array([self.known[p] for c in cuts for p in c], dtype=np.int64)]
            self.rows[n + has, :-1] = np.add.reduceat(ll, (np.cumsum(size) - size)[has])
            self.rows[n + has, -1] = 1

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [t.lower().split() if t else [] for t in texts]
        if len(self.at) > CACHE_WORDS:
            self.forget()
        seen: set[str] = set().union(*words)
        self._learn(list(seen.difference(self.at)))
        best, post = [], np.zeros(len(texts))
        for i, ws in enumerate(words):
            total = self.rows[np.fromiter(map(self.at.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(0)
            if not total[-1] or not self.langs:
                best.append("und")
                continue
            ll = total[:-1]
            k = int(ll.argmax())
            best.append(self.langs[k])
            post[i] = 1 / np.exp(ll - ll[k]).sum()
        return best, post


def _word_counts(batches):
    for b in batches:
        n: dict[tuple[str, str], int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in text.lower().split():
                n[lang, w] = n.get((lang, w), 0) + 1
        out: dict[tuple[str, str], int] = {}
        for (lang, w), c in n.items():
            for p in parts_of(w):
                out[lang, p] = out.get((lang, p), 0) + c
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([p for _, p in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "word", "n"])


def _expect(probs: dict[str, np.ndarray] | None, path: str | None):
    def run(batches):
        claim("langid")
        vocab = vocabulary(path)
        flat = np.full((len(vocab) + 1, 1), 1 / len(vocab))
        flat[0] = UNKNOWN
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            word, n = b.column(1).to_pylist(), b.column(2).to_numpy().astype(float)
            cols: list[list] = [[], [], []]
            for k in sorted(set(lang)):
                rows = np.flatnonzero(lang == k)
                got = expected_counts([word[i] for i in rows], n[rows], vocab, probs[k] if probs else flat)
                used = np.flatnonzero(got)
                for c, x in zip(cols, ([k] * len(used), used.tolist(), got[used].tolist()), strict=True):
                    c += x
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], names=["lang", "piece", "uses"])

    return run


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a matrix (piece, language) of probabilities; docs: (doc_id, text, lang) to learn from."""
    ship(docs.sparkSession)
    known = docs.where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    vocab = vocabulary(path)
    if not langs:
        return [], np.zeros((len(vocab) + 1, 0))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    bound = F.lit(0)
    for k in langs:
        bound = F.when(F.col("lang") == k, int(1_000_000 * min(1.0, per_language / sizes[k]))).otherwise(bound)
    words = known.where(pick < bound).select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    probs: dict[str, np.ndarray] | None = None
    for _ in range(rounds):
        got = words.mapInArrow(_expect(probs, path), "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect()
        probs = {k: np.full((len(vocab) + 1, 1), ALPHA) for k in langs}
        for r in sorted(got):
            if r.piece:
                probs[r.lang][r.piece] += r.uses
        for p in probs.values():
            p[0] = 0
            p /= p.sum()
            p[0] = UNKNOWN
    words.unpersist()
    return langs, np.concatenate([probs[k] for k in langs], axis=1)


def _tell(model):
    def run(batches):
        claim("langid")
        langs, probs, path, key = model.value
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(langs, probs, path)
        try:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    lang, score = _SCORERS[key].score(b.column(1).slice(at, 500).to_pylist())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
        finally:
            _SCORERS[key].forget()
            give_back()

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    import hashlib

    ship(docs.sparkSession)
    key = hashlib.sha256(repr(model[0]).encode() + model[1].tobytes()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((*model, path, key))  # languages times vocabulary
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_tell(sent), "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))


def language_filter(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents whose language is told with a posterior of ``keep`` or more; columns as they were.

    Rows are told by a hash of doc_id and text, so documents with a null or repeated doc_id are judged each by its text.
    """
    row = F.xxhash64(docs["doc_id"], docs["text"])
    told = predict(docs.select(row.alias("doc_id"), "text"), learned(docs))
    bad = told.where((F.col("lang_pred") == "und") | (F.col("score") < keep)).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, row == bad["_bad"], "left_anti")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, learned(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
