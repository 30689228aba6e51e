"""Quality classifier from weak labels.

Ten heuristic labellers vote good, bad or abstain on every document. The counts
of all vote patterns (at most 3 ** 10, whatever the corpus) give, by
expectation-maximisation, each labeller's accuracies and the share of good
documents. The posterior of a document's pattern is its soft label, and a
linear scorer over hashed words, word shapes and pairs of shapes is trained on
the soft labels of a hash-chosen sample of about ``TRAIN_DOCS`` documents, or
fewer, so that they have about ``TRAIN_WORDS`` words (the bounds on what the
driver trains on). Votes, pattern counts and scores cover
every whole text. No quality label is read; labels serve as a test.

``score`` is the mean of the scorer's probability and the posterior; documents
of ``THRESHOLD`` or more are kept.

Defined cases: a null text or one without words scores 0 and is rejected;
repeated rows each get a row; an empty table gives an empty result; without
any document of one class the scorer falls back to the posterior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import arrow_text as at
from quarry.llm.quality_rules import COMMON_WORDS
from quarry.plans.workspace import Workspace

GOOD, BAD, ABSTAIN = 2, 0, 1
TRAIN_DOCS = 20_000
TRAIN_WORDS = 20_000_000
DIMENSIONS = 1 << 17
THRESHOLD = 0.5
MIN_WORDS = 20

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER |= _UPPER
_LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Shape of a byte: upper, lower, digit, or the character itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    lens = np.array([len(x) for x in raw])
    return np.sort(at.byte_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lens) - lens, lens))


_COMMON = _hashes(sorted({w for words in COMMON_WORDS.values() for w in words.split()}))


class Doc:
    """Word-level arrays of a slice of texts."""

    def __init__(self, t: at.Texts):
        self.t, self.w = t, at.words(t, at.NOT_SPACE)
        w = self.w
        self.n = np.diff(w.first)
        self.some = np.flatnonzero(self.n > 0)
        self.starts = w.first[:-1][self.some]
        low = at.LOWER[t.data]
        self.hash = at.byte_hashes(low, w.starts, w.lens)
        self.last = low[w.starts + w.lens - 1] if len(w.starts) else np.zeros(0, np.uint8)

    def share(self, x: np.ndarray) -> np.ndarray:
        """The mean over a text's words; 0 without words."""
        out = np.zeros(len(self.t))
        if len(self.some):
            out[self.some] = np.add.reduceat(x.astype(np.float64), self.starts) / self.n[self.some]
        return out

    def per_byte(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[self.t.data])])
        return (total[self.t.offsets[1:]] - total[self.t.offsets[:-1]]).astype(np.float64)

    def in_word(self, mask: np.ndarray) -> np.ndarray:
        """Whether each word has a byte of the mask."""
        total = np.concatenate([[0], np.cumsum(mask[self.t.data])])
        return total[self.w.starts + self.w.lens] > total[self.w.starts]


def votes(d: Doc) -> np.ndarray:
    """A row of ten votes for each text."""
    n = len(d.t)
    w = d.w
    letters = np.maximum(d.per_byte(_LETTER), 1)

    def vote(x: np.ndarray, bad, good) -> np.ndarray:
        return np.where(bad(x), BAD, np.where(good(x), GOOD, ABSTAIN))

    symbol = d.share(d.in_word(_SYMBOL))
    bare = d.share(~d.in_word(_LETTER))
    upper = d.per_byte(_UPPER) / letters
    common = d.share(_COMMON[np.minimum(np.searchsorted(_COMMON, d.hash), len(_COMMON) - 1)] == d.hash)
    mean = d.share(w.lens)
    stops = d.share((d.last == ord(".")) | (d.last == ord(",")))
    shout = d.share((d.last == ord("!")) | (d.last == ord("?")))
    # Repetition: share of words equal to the one before; share of distinct words against what is usual at that length.
    again = np.zeros(len(d.hash), bool)
    again[1:] = d.hash[1:] == d.hash[:-1]
    again[w.first[:-1][w.first[:-1] < len(again)]] = False
    echo = d.share(again)
    kinds = np.zeros(n)
    for i in d.some.tolist():
        a, b = w.first[i], w.first[i + 1]
        kinds[i] = len(np.unique(d.hash[a:b])) / (b - a) ** 0.85
    out = np.stack(
        [
            vote(symbol, lambda x: x > 0.15, lambda x: x < 0.03),
            vote(bare, lambda x: x > 0.2, lambda x: x < 0.06),
            vote(upper, lambda x: x > 0.4, lambda x: x < 0.15),
            vote(common, lambda x: x < 0.08, lambda x: x > 0.2),
            vote(mean, lambda x: (x > 10) | (x < 2.2), lambda x: (x > 3) & (x < 8.5)),
            vote(stops, lambda x: x < 0.02, lambda x: x > 0.05),
            vote(shout, lambda x: x > 0.25, lambda x: x < 0.02),
            vote(echo, lambda x: x > 0.2, lambda x: x < 0.03),
            vote(kinds, lambda x: x < 0.4, lambda x: x > 0.9),
            np.where(d.n == 0, BAD, np.where(d.n > 60, GOOD, ABSTAIN)),
        ],
        1,
    )
    # Shares of a few words say little: labellers of shares don't call a short text bad.
    short = (d.n > 0) & (d.n < MIN_WORDS)
    out[short] = np.where((out[short] == BAD) & SHARES, ABSTAIN, out[short])
    return out.astype(np.int64)


LABELLERS = 10
#: Labellers of word shares; the others look for junk characters.
SHARES = np.array([False, False, False, True, True, True, False, True, True, True])
_PLACE = 3 ** np.arange(LABELLERS)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in at.slices(batch.column(0)):
            d = Doc(t)
            code, where, n = np.unique(votes(d) @ _PLACE, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), pa.array(np.bincount(where, d.n, len(code)).astype(np.int64))], ["pattern", "n", "words"])


class LabelModel:
    """Accuracies of the labellers and the posterior of every vote pattern seen."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        v = patterns[:, None] // _PLACE % 3
        n = counts.astype(np.float64)
        if not len(n):
            v, n = np.full((1, LABELLERS), ABSTAIN), np.ones(1)
        # Begin from the votes' majority; abstentions carry information too, as a third outcome.
        good = 1 / (1 + np.exp(-((v == GOOD).sum(1) - 2.0 * (v == BAD).sum(1))))
        for _ in range(rounds):
            self.prior = float(np.clip((good * n).sum() / n.sum(), 0.01, 0.99))
            self.given = np.stack([self._table(v, n * good), self._table(v, n * (1 - good))])
            new = self.posterior(v)
            if np.abs(new - good).max() < 1e-6:
                break
            good = new
        self.accuracy = self.prior * self.given[0][:, GOOD] + (1 - self.prior) * self.given[1][:, BAD]

    @staticmethod
    def _table(v: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.stack([((v == k) * n[:, None]).sum(0) + 1.0 for k in range(3)], 1) / (n.sum() + 3.0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at_ = np.arange(LABELLERS)
        odds = np.log(self.prior / (1 - self.prior)) + (np.log(self.given[0][at_, v]) - np.log(self.given[1][at_, v])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def hashed(d: Doc) -> np.ndarray:
    """Three hashed features for each word: the word, its shape, its and the last one's shape."""
    t, w = d.t, d.w
    if not len(w.starts):
        return np.zeros((0, 3), np.int64)
    s = _SHAPE[t.data]
    turn = np.ones(len(s), bool)
    turn[1:] = s[1:] != s[:-1]
    turn[w.starts] = True
    kept = np.cumsum(turn)
    begin = kept[w.starts] - 1
    lens = kept[w.starts + w.lens - 1] - begin
    shape = at.byte_hashes(s[turn], begin, lens)
    before = np.concatenate([[np.uint64(0)], shape[:-1]])
    before[w.first[:-1][w.first[:-1] < len(before)]] = 0  # nothing stands before a text's first word
    pair = at.mix(before * at.BASE + shape)
    return np.stack([d.hash % np.uint64(DIMENSIONS // 2), shape % np.uint64(DIMENSIONS // 4) + np.uint64(DIMENSIONS // 2), pair % np.uint64(DIMENSIONS // 4) + np.uint64(3 * DIMENSIONS // 4)], 1).astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in at.slices(batch.column(0)):
            d = Doc(t)
            x, code = hashed(d), votes(d) @ _PLACE
            feats = [np.unique(x[d.w.first[i] : d.w.first[i + 1]], return_counts=True) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(t.first, len(t)), pa.array(code), pa.array([f.astype(np.int32) for f, _ in feats], pa.list_(pa.int32())), pa.array([(c / max(1, n)).astype(np.float32) for (_, c), n in zip(feats, d.n)], pa.list_(pa.float32()))], ["key", "pattern", "at", "share"]
            )


def train(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.5, seed: int = 3) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias) for shares of features, by AdaGrad on soft labels."""
    weights, seen = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
    rng = np.random.default_rng(seed)
    full = [i for i, (f, _) in enumerate(rows) if len(f)]
    # Both classes weigh alike.
    mass = max(1e-9, float(soft[full].sum())), max(1e-9, float((1 - soft[full]).sum()))
    for _ in range(epochs):
        rng.shuffle(full)
        for a in range(0, len(full), batch):
            part = full[a : a + batch]
            f = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            begin = np.cumsum(sizes) - sizes
            y = soft[part]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[f] * x, begin) + weights[-1], -30, 30)))
            g = (y * (p - 1) / mass[0] + (1 - y) * p / mass[1]) * (mass[0] + mass[1]) / 2 / len(part)
            uniq, where = np.unique(f, return_inverse=True)
            grad = np.bincount(where, np.repeat(g, sizes) * x, len(uniq))
            seen[uniq] += grad**2
            weights[uniq] -= rate * grad / np.sqrt(seen[uniq])
            seen[-1] += g.sum() ** 2
            weights[-1] -= rate * 0.1 * g.sum() / np.sqrt(seen[-1])
    return weights


def _score(text_at: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, weights = shared.value
        for batch in batches:
            for t in at.slices(batch.column(text_at)):
                d = Doc(t)
                x = hashed(d)
                post = label.posterior(votes(d))
                p = post
                if weights is not None:
                    p = 1 / (1 + np.exp(-np.clip(d.share(weights[x].sum(1)) + weights[-1], -30, 30)))
                some = d.n > 0
                score = np.where(some, (p + post) / 2, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(t.first, len(t)) for c in range(batch.num_columns)] + [pa.array(np.where(some, post, 0.0)), pa.array(np.where(some, p, 0.0)), pa.array(score)],
                    names=[*batch.schema.names, "weak_label", "linear_score", "quality_score"],
                )

    return run


def fit(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> tuple[LabelModel, np.ndarray | None]:
    """The label model of all documents, and the scorer's weights."""
    texts = docs.select(docs[text_col].cast("string").alias("text"))
    seen = texts.mapInArrow(_patterns, "pattern long, n long, words long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas()  # at most 3 ** 10 rows
    label = LabelModel(seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(np.int64))
    total = int(seen["n"].sum())
    share = min(1.0, train_docs / max(1, total), TRAIN_WORDS / max(1, int(seen["words"].sum())))
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else texts
    # Equal texts count once, or one much copied text could fill the sample.
    rows = chosen.distinct().select("text", F.xxhash64("text").alias("key")).mapInArrow(_examples, "key long, pattern long, at array<int>, share array<float>").toArrow()
    if not rows.num_rows:
        return label, None
    pattern = np.asarray(rows.column("pattern"))
    soft = label.posterior(pattern[:, None] // _PLACE % 3)
    if soft.min() > 0.5 or soft.max() < 0.5:
        return label, None
    lists = [rows.column(c).combine_chunks() for c in ("at", "share")]
    off, flat = np.asarray(lists[0].offsets), [np.asarray(x.values) for x in lists]
    data = [(flat[0][a:b], flat[1][a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    # In the order of their hashes, so that the weights don't depend on how the documents lie.
    order = np.argsort(np.asarray(rows.column("key")), kind="stable")
    return label, train([data[i] for i in order.tolist()], soft[order]).astype(np.float32)


def classify(spark: SparkSession, docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with weak_label, linear_score, quality_score and kept added, in place of columns of these names."""
    docs = docs.drop("weak_label", "linear_score", "quality_score", "kept")
    model = spark.sparkContext.broadcast(fit(docs, text_col))  # 3 ** 10 patterns' tables and DIMENSIONS floats
    schema = docs.select("*", *(F.lit(0.0).alias(c) for c in ("weak_label", "linear_score", "quality_score"))).schema
    return docs.mapInArrow(_score(docs.columns.index(text_col), model), schema).withColumn("kept", F.col("quality_score") >= threshold)


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = classify(spark, docs)
    return got.select("doc_id", *(F.round(c, 6).alias(c) for c in ("weak_label", "linear_score", "quality_score")), "kept")
