"""Toxicity from two Kneser-Ney models, one of toxic and one of ordinary documents, over the counts of the whole corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._base import dropped, tidy, written
from ._text import U64, byte_view, chunks, mix64, spread, words_of
from .decontaminate import _NORMAL

#: Labelled documents of each class that the models are fitted on at most, those with the least hash of their id. The
#: bound keeps the fitted model small enough for one task to make and every task to hold.
TRAIN_DOCS = 4000
#: Rows whose crc32 of the id leaves 0 by this are never learnt from.
FOLDS = 5
#: Bytes of context of the longest order: with the byte itself a key is one 64-bit number.
LONGEST = 7
DISCOUNT = 0.75
#: Share of a toxic document's words that are toxic expressions; the rest of it is as in ordinary ones.
TOXIC_SHARE = 0.01
#: Words that a text's mean log-likelihood ratio is stretched by, so that a few words alone say little.
PRIOR_WORDS = 10
#: Different n-grams that a task counts before it passes them on.
HELD_GRAMS = 1 << 19


def held_out(id_col: str):
    """True where the id's crc32 leaves 0; a null id is held out as well."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _words(raw: np.ndarray, off: np.ndarray):
    """Words in lower case without ASCII punctuation: a mark beside a word doesn't make it another word."""
    return words_of(np.frombuffer(raw.tobytes().translate(_NORMAL.tobytes()), np.uint8), off)


def _spellings(w, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): LONGEST bytes before each byte of the picked words and that byte, as one number, first byte highest.

    A word stands between spaces: LONGEST of them before it, one after it, which is foretold as well.
    """
    length = (w.end - w.start)[pick]
    size = length + LONGEST + 1
    text = np.full(int(size.sum()), 32, np.uint8)
    first = np.cumsum(size) - size
    inner = spread(length)
    text[np.repeat(first + LONGEST, length) + inner] = w.raw[np.repeat(w.start[pick], length) + inner]
    n = length + 1
    at = np.repeat(first, n) + spread(n)
    keys = np.zeros(len(at), U64)
    for k in range(LONGEST + 1):
        keys = (keys << U64(8)) | text[at + k]
    return keys, np.cumsum(n) - n


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys with only their last `order` bytes of context."""
    return keys & U64((1 << 8 * (order + 1)) - 1)


class Table:
    """A float for each of some keys, found by the first bits of their hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, salt: int):
        keys = mix64(keys + U64(salt))
        self.salt = U64(salt)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = U64(64 - max(8, int(2 * len(keys)).bit_length()))
        bins = 1 << int(64 - self.shift)
        self.start = np.searchsorted(self.keys, np.arange(bins, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))
        self.longest = int(np.diff(self.start).max(initial=0))

    def get(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in q that have a key, their values)."""
        q = mix64(q + self.salt)
        b = (q >> self.shift).astype(np.int64)
        lo, hi = self.start[b], self.start[b + 1]
        some = np.flatnonzero(hi > lo)
        places, values = [], []
        for k in range(self.longest):
            at = lo[some].astype(np.int64) + k
            some, at = some[at < hi[some]], at[at < hi[some]]
            same = self.keys[at] == q[some]
            places.append(some[same])
            values.append(self.values[at[same]])
        return (np.concatenate(places), np.concatenate(values)) if places else (some[:0], np.zeros(0, np.float32))


def shared_probabilities(order: np.ndarray, key: np.ndarray, n: np.ndarray, total: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, P(byte | context) in the whole corpus) of the longest order, by interpolated Kneser-Ney over all orders.

    A row for each key of each order: how often it counts, how often its context does, and what all keys of that
    context lose to the discount.
    """
    known, p = np.zeros(1, U64), np.full(1, 1 / 256)
    for o in range(LONGEST + 1):
        at = np.flatnonzero(order == o)
        at = at[np.argsort(key[at])]
        rest = p[np.searchsorted(known, _low(key[at], o - 1))] if o else p[np.zeros(len(at), np.int64)]
        known, p = key[at], (np.maximum(n[at] - DISCOUNT, 0) + left[at] * rest) / total[at]
    return known, p


class Model:
    """log P(word | toxic) - log P(word | ordinary), spelt byte by byte, by interpolated Kneser-Ney models.

    P_c(x|h) = max(n_c(hx) - D, 0) / n_c(h) + share_c(h) * P(x|h), h being the LONGEST bytes before x in its word and the spaces
    before it. P is the Kneser-Ney model of all documents, labelled or not, over its own shorter contexts: what a class has
    hardly seen is smoothed by counts that it shares with the other, and where neither has seen hx, P cancels out.
    """

    def __init__(self, keys: np.ndarray, counts: list[np.ndarray], known: np.ndarray, shared: np.ndarray):
        """keys: spellings in the classes' sample; counts: how often the ordinary and the toxic class have them; shared: P of the known keys."""
        heads, head = np.unique(keys >> U64(8), return_inverse=True)
        rest = shared[np.searchsorted(known, keys)]
        probs, shares = [], []
        for n in counts:
            total = np.bincount(head, weights=n, minlength=len(heads))
            lost = np.bincount(head, weights=np.minimum(n, DISCOUNT), minlength=len(heads))
            shares.append(np.where(total > 0, lost / np.maximum(total, 1), 1.0))
            probs.append(np.maximum(n - DISCOUNT, 0) / np.maximum(total[head], 1) + shares[-1][head] * rest)
        self.seen = Table(keys, np.log(probs[1]) - np.log(probs[0]), 1)
        self.share = Table(heads, np.log(shares[1]) - np.log(shares[0]), 2)

    def ratios(self, w) -> np.ndarray:
        """Log ratio of each word; every different word is spelt once."""
        if not len(w.hash):
            return np.zeros(0)
        _, pick, which = np.unique(w.hash, return_index=True, return_inverse=True)
        keys, first = _spellings(w, pick)
        each = np.zeros(len(keys))
        at, v = self.seen.get(keys)
        each[at] = v
        new = np.ones(len(keys), bool)
        new[at] = False
        new = np.flatnonzero(new)
        at, v = self.share.get(keys[new] >> U64(8))
        each[new[at]] = v
        return np.add.reduceat(each, first)[which]

    def mean_ratio(self, w) -> np.ndarray:
        """Each document's log-likelihood as a toxic one less that as an ordinary one, by its length.

        A toxic document has toxic expressions among ordinary words, so its words come from both models, TOXIC_SHARE from the toxic one.
        """
        n = w.count
        each = np.logaddexp(np.log(1 - TOXIC_SHARE), np.log(TOXIC_SHARE) + self.ratios(w))
        sums = np.add.reduceat(np.append(each, 0.0), np.minimum(w.first[:-1], len(each))) if len(n) else np.zeros(0)
        return np.where(n > 0, sums, 0.0) / (n + PRIOR_WORDS)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a weighted logistic regression by Newton steps with a little ridge; x has a column of ones."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        move = np.linalg.solve(hess, x.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return beta


def _sample_words(rows: list[tuple]) -> Iterator[tuple[int, int, object]]:
    """(i, j, words of rows i to j), about CHUNK_BYTES of text at a time, as hashing words takes many times their bytes."""
    off = np.concatenate([[0], np.cumsum([len(t) for _, _, t in rows])]).astype(np.int64)
    for i, j in chunks(off):
        yield i, j, _words(np.frombuffer(b"".join(t for _, _, t in rows[i:j]), np.uint8), off[i : j + 1] - off[i])


def _added(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of both and the sums of their counts, one row a group."""
    out, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
    both = np.concatenate([counts, n], axis=1)
    return out, np.stack([np.bincount(at, weights=x, minlength=len(out)) for x in both])


def _key_counts(rows: list[tuple], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Different spelling keys of the rows' words, and how often each group of rows has them."""
    keys, n = np.zeros(0, U64), np.zeros((groups, 0))
    for i, j, w in _sample_words(rows):
        if not len(w.hash):
            continue
        _, pick, which = np.unique(w.hash, return_index=True, return_inverse=True)
        spelt, first = _spellings(w, pick)
        of = group[i:j][w.doc]
        often = np.stack([np.bincount(which[of == g], minlength=len(pick)) for g in range(groups)]).astype(float)
        keys, n = _added(keys, n, spelt, np.repeat(often, np.diff(np.append(first, len(spelt))), axis=1))
    return keys, n


def _fit(rows: list[tuple], shared: tuple[np.ndarray, np.ndarray], amount: dict[int, int]) -> tuple[Model, np.ndarray]:
    """rows: (hash, toxic, text); amount: labelled rows of each class. Each half is scored by the model of the other to set the score's scale."""
    y = np.array([t for _, t, _ in rows], int)
    half = np.array([h & 1 for h, _, _ in rows], int)
    keys, n = _key_counts(rows, 2 * half + y, 4)

    def model(*halves: int) -> Model:
        both = [sum(n[2 * k + c] for k in halves) for c in (0, 1)]
        some = both[0] + both[1] > 0
        return Model(keys[some], [x[some] for x in both], *shared)

    if not (0 < y.sum() < len(y)):  # one class only: nothing tells them apart
        return model(0, 1), np.array([0.0 if not len(rows) else (2.0 if y.all() else -2.0), 0.0])
    x = np.zeros(len(rows))
    for k in (0, 1):
        if 0 < y[half == k].sum() < (half == k).sum():
            other, places = model(k), np.flatnonzero(half != k)
            for i, j, w in _sample_words([rows[p] for p in places]):
                x[places[i:j]] = other.mean_ratio(w)
    weight = np.array([amount[c] / max(1, (y == c).sum()) for c in (0, 1)])
    return model(0, 1), logistic(np.stack([np.ones(len(x)), x], 1), y, (weight / weight.min())[y])


@tidy
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spelling keys of all words and how often they occur, summed up over a task as far as HELD_GRAMS."""
    keys, n = np.zeros(0, U64), np.zeros((1, 0))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[0].astype(np.int64))], ["key", "n"])

    for batch in batches:
        raw, off = byte_view(batch.column(0))
        for i, j in chunks(off):
            w = _words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            if not len(w.hash):
                continue
            _, pick, often = np.unique(w.hash, return_index=True, return_counts=True)
            spelt, first = _spellings(w, pick)
            keys, n = _added(keys, n, spelt, np.repeat(often, np.diff(np.append(first, len(spelt))))[None, :].astype(float))
            if len(keys) >= HELD_GRAMS:
                yield out()
                keys, n = keys[:0], n[:, :0]
    yield out()


def _orders(grams: DataFrame, count: str) -> DataFrame:
    """A row for each order of each key: the last bytes of its context and its byte."""
    mask = lambda o: F.lit(-1 if o == LONGEST else (1 << 8 * (o + 1)) - 1).cast("long")
    orders = F.array(*(F.struct(F.lit(o).alias("o"), F.col("key").bitwiseAND(mask(o)).alias("key")) for o in range(LONGEST + 1)))
    return grams.select(F.explode(orders).alias("k"), count).select("k.o", "k.key", count)


def corpus_counts(texts: DataFrame, sample: DataFrame, text_col: str = "text") -> DataFrame:
    """(o, key, n, total, left): Kneser-Ney counts in all texts, of every order, for the keys that the sample has.

    The counts of all n-grams are a distributed table that grows with the corpus; what the sample has of them is bounded by the
    sample. n counts occurrences at the longest order and in contexts that begin a word, at the others different bytes before.
    """
    kind = "key long, n long"
    whole = written(texts.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(_gram_counts, kind).groupBy("key").agg(F.sum("n").alias("n")), "ngrams")
    raw = written(_orders(whole, "n").groupBy("o", "key").agg(F.sum("n").alias("n")), "ngrams")
    low = F.expr(f"element_at(array({', '.join(str((1 << 8 * o) - 1) + 'L' for o in range(1, LONGEST + 1))}), o)")
    kinds = raw.where("o > 0").select((F.col("o") - 1).alias("o"), F.col("key").bitwiseAND(low).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("kinds"))
    both = raw.withColumn("kinds", F.lit(0)).unionByName(kinds).groupBy("o", "key").agg(F.sum("n").alias("raw"), F.sum("kinds").alias("kinds"))
    begins = F.expr("o > 0 AND (shiftrightunsigned(key, 8 * o) & 255) = 32")
    counts = written(both.select("o", "key", F.when((F.col("o") == LONGEST) | begins, F.col("raw")).otherwise(F.col("kinds")).alias("n"), F.shiftrightunsigned("key", 8).alias("head")), "ngrams")
    heads = counts.groupBy("o", "head").agg(F.sum("n").alias("total"), F.sum(F.least(F.col("n").cast("double"), F.lit(DISCOUNT))).alias("left"))
    wanted = _orders(sample.select(text_col).mapInArrow(_gram_counts, kind), "n").select("o", "key").distinct()
    out = written(counts.join(wanted, ["o", "key"]).join(heads, ["o", "head"]).select("o", "key", "n", "total", "left"), "ngrams-wanted")
    dropped(whole, raw, counts)
    return out


def _scorer(sent):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, beta = _model(sent)
        for batch in batches:
            raw, off = byte_view(batch.column(1))
            for i, j in chunks(off):
                w = _words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                z = beta[0] + beta[1] * model.mean_ratio(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    return run


_last: list = [None, None]


def _model(sent) -> tuple[Model, np.ndarray]:
    if _last[0] != sent.id:
        _last[:] = [sent.id, sent.value]
    return _last[1]


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    The class models see the labelled rows that are not held out, whole, at most train_docs of either class; the counts that
    they share come from all documents. The driver gets the sample and the corpus's counts of the n-grams in it, both
    limited by train_docs, fits the models and broadcasts their log ratios. A score is the logistic function of a text's log-likelihood ratio by
    its length, on a scale that is fitted to rows scored by a model that has not seen them. A score depends on a text alone: null, empty and
    blank texts get that of no evidence. An id with several labels counts once, toxic if any is; repeated rows are scored one
    by one. Without labels of both classes all scores are alike. Other columns aren't read. Empty tables give empty results.
    """
    from .decontaminate import _Block

    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.withColumn("h", F.xxhash64("id"))
    amount = {0: 0, 1: 0} | {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("y = 0").orderBy("h", "id").limit(train_docs).unionByName(known.where("y = 1").orderBy("h", "id").limit(train_docs))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = written(texts.where("text IS NOT NULL").join(F.broadcast(chosen.select("id", "y", "h")), "id"), "toxic-sample")
    wanted = corpus_counts(texts, sample)
    got = [wanted.select(c).toArrow().column(0).to_numpy() for c in wanted.columns]
    shared = shared_probabilities(got[0], got[1].astype(np.int64).view(U64), *got[2:])
    rows = sorted(((r.h, r.y, r.text.encode()) for r in sample.toLocalIterator()), key=lambda r: (r[0], r[2]))
    dropped(sample, wanted)
    block = _Block(uuid.uuid4().hex, spark.sparkContext.broadcast(_fit(rows, shared, amount)))
    del rows, got, shared
    scored = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(_scorer(block), f"id {dict(docs.dtypes)[id_col]}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
