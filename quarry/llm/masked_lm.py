"""Masked pseudo-likelihood by a bidirectional window network.

Words are told apart by 63 bits of hash. Spark counts them over every document
into a table of one row a word, which stays distributed and grows with the
corpus. The counts order the words into classes, about half as many as the root
of the vocabulary: frequent words are classes of their own, the others
share classes of near equal mass. The network sees the classes of two words on
either side of a masked position and predicts the masked word's class by a
hierarchical softmax, first one of the groups of ``CLASSES`` classes, then the
class; within its class a word has its share of the corpus's counts. A
document's score is the sum over its positions of the conditional
log-probabilities (its pseudo-log-likelihood).

1. Texts are cut into words once, in slices; each slice lists its distinct words.
2. Those lists give the counts, and are joined with them again; every slice gets
   the counts of its own words and turns its words into classes and shares.
3. Training starts from the classes' own shares and takes ``ROUNDS`` steps of Adam,
   each on the gradient of its own part of all documents, chosen by their hash.
   Tasks sum gradients, Spark sums the tasks', and the driver takes the step, so
   scores don't depend on how the documents lie in partitions (but for rounding).

The network, the frequent words and a row for each count that occurs are
broadcast; all three grow with a root of the corpus. No list of words is.

Defined cases: a null or wordless text has no tokens, a sum of 0 and a null
mean; text ends are a class of their own; a word that training didn't see has
the rarest class, and a count of 0; repeated rows each get a row; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import arrow_text as at
from quarry.plans.workspace import Workspace

#: Values of a word's hash: with a billion distinct words, the chance that any two share one is about 0.05.
BUCKETS = 1 << 63
#: Classes of a group of the hierarchical softmax (the least number of classes), and how many of them are single words.
CLASSES = 64
FREQUENT = 40
HIDDEN = 16
WINDOW = 2
ROUNDS = 12
BATCH = 4096
#: Texts are cut into slices of this size (a longer text is a slice by itself).
SLICE_BYTES = 1 << 21
#: Words of slices' lists that are looked up in one group.
PART = 1 << 20
#: The class beyond a text's ends, in a network of one group; in general the number of classes.
EDGE = CLASSES


def _tokens(t: at.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words (lower-cased), and where each text's begin."""
    t.data = at.LOWER[t.data]
    w = at.words(t, at.NOT_SPACE)
    return (at.byte_hashes(t.data, w.starts, w.lens) % np.uint64(BUCKETS)).astype(np.int64), w.first


def _pack(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about a slice: the larger a slice, the fewer words are listed more than once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _narrow(n: int) -> type:
    """The type for numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.int32


def _cut(text_at: int, kept: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in _gather(batches):
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in kept], names=[batch.schema.names[c] for c in kept])
            for t in at.slices(batch.column(text_at), SLICE_BYTES):
                word, first = _tokens(t)
                own, place, count = np.unique(word, return_inverse=True, return_counts=True)
                parts = (first.astype(np.int64), own, count.astype(np.int64), place.astype(_narrow(len(own))))
                yield pa.RecordBatch.from_arrays([pa.array([n])] + [pa.array([x.tobytes()], pa.binary()) for x in parts] + [pa.array([_pack(rows.slice(t.first, len(t)))], pa.binary())], ["slice", "first", "own", "count", "place", "body"])
                n += 1

    return run


def cut(docs: DataFrame, text_col: str, kept: list[int], ws: Workspace) -> DataFrame:
    """A row for each slice: where its texts begin, its distinct words, their counts, each position's word, and the kept columns."""
    text = docs.select("*", docs[text_col].cast("string").alias("_text"))
    return ws.stage(text.mapInArrow(_cut(len(docs.columns), kept), "slice long, first binary, own binary, count binary, place binary, body binary"), "slices")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, count in zip(*(batch.column(c).to_pylist() for c in range(2))):
            word = np.frombuffer(own, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.frombuffer(count, np.int64))], ["word", "n"])


def word_lists(slices: DataFrame) -> DataFrame:
    """The distinct words of every slice with their counts there: word, n."""
    return slices.select("own", "count").mapInArrow(_list, "word long, n long")


def _split(bits: int, shared):
    """The words of a slice by parts of the range of hashes, without frequent ones: a part of such a word would get a row from every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, own in zip(*(batch.column(c).to_pylist() for c in range(2))):
                word = np.frombuffer(own, np.int64)
                word = word[~shared.value.is_frequent(word)[0]]
                cuts = np.flatnonzero(np.diff(word >> (63 - bits), prepend=-1)).tolist()
                parts = [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(parts), pa.int64()), pa.array([int(x[0]) >> (63 - bits) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "part", "own"])

    return run


def _frequent(shared):
    """For each slice which of its words are frequent, as bits, and the classes of these; part -1 comes first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = shared.value
        for batch in batches:
            for n, own in zip(*(batch.column(c).to_pylist() for c in range(2))):
                hit, klass = bands.is_frequent(np.frombuffer(own, np.int64))
                bits, klass = np.packbits(hit).tobytes(), klass.astype(_narrow(bands.classes)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([-1], pa.int64()), pa.array([klass], pa.binary()), pa.array([bits], pa.binary())], ["slice", "part", "klass", "share"])

    return run


class Bands:
    """The class of a word of a given count; broadcast, without any list of the words beyond the frequent ones."""

    def __init__(self, classes: int, frequent: np.ndarray, levels: np.ndarray, sizes: np.ndarray):
        """Frequent words, most frequent first; the counts of all others, ascending, and how many words have each."""
        self.classes, self.order, self.levels, self.sizes = classes, np.argsort(frequent), levels, sizes
        self.frequent = frequent[self.order]
        self.singles = classes * FREQUENT // CLASSES
        mass = (levels + 1.0) * sizes
        self.total = float(mass.sum())
        self.start = self.total - np.cumsum(mass)
        self.mass = np.ones(classes)

    def klass(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Words of equal counts are spread by their hash over the bands that their count covers."""
        bands = self.classes - self.singles
        at = np.full(len(word), self.total)
        if len(self.levels):
            j = np.minimum(np.searchsorted(self.levels, n), len(self.levels) - 1)
            known = self.levels[j] == n
            at = np.where(known, self.start[j] + (n + 1.0) * self.sizes[j] * (word / BUCKETS), at)
        out = self.singles + np.minimum((at / max(self.total, 1.0) * bands).astype(np.int64), bands - 1)
        if not self.total:
            out[:] = self.classes - 1
        if len(self.frequent):
            j = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
            out = np.where(self.frequent[j] == word, self.order[j], out)
        return out

    def is_frequent(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a class of their own, of which their share is all, and these classes."""
        if not len(self.frequent):
            return np.zeros(len(word), bool), np.zeros(0, np.int64)
        j = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
        hit = self.frequent[j] == word
        return hit, self.order[j[hit]]

    def log_share(self, klass: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.log((n + 1.0) / self.mass[klass])


def _masses(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = shared.value
        for batch in batches:
            word, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            mass = np.bincount(bands.klass(word, n), n + 1.0, bands.classes)
            some = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(mass[some])], ["klass", "mass"])

    return run


class _Column:
    """Classes or log shares of single words, fetched from the table as they are asked for."""

    def __init__(self, vocab: "Vocabulary", share: bool):
        self.vocab, self.share, self.known = vocab, share, {}

    def __getitem__(self, word: int):
        if word not in self.known:
            got = self.vocab.table.filter(F.col("word") == int(word)).first()
            w, n = np.array([word], np.int64), np.array([got["n"] if got else 0], np.int64)
            k = self.vocab.bands.klass(w, n)
            self.known[word] = float(self.vocab.bands.log_share(k, n)[0]) if self.share else int(k[0])
        return self.known[word]

    def max(self) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                k = bands.klass(w, n)
                yield pa.RecordBatch.from_arrays([pa.array((bands.log_share(k, n) if self_share else k).astype(np.float64))], ["x"])

        bands, self_share = self.vocab.bands, self.share
        return self.vocab.table.mapInArrow(run, "x double").agg(F.max("x")).first()[0]


class Vocabulary:
    """The counts of all words as a distributed table (word, n), and the bands that give their classes."""

    def __init__(self, table: DataFrame):
        spark = table.sparkSession
        self.table = table
        groups = max(1, round(table.count() ** 0.5 / (2 * CLASSES)))
        top = table.orderBy(F.desc("n"), "word").limit(groups * FREQUENT).toPandas()  # as many as the root of the vocabulary
        levels = table.groupBy("n").agg(F.count("*").alias("size")).orderBy("n").toPandas()  # a row per count that occurs
        n, size = levels["n"].to_numpy(np.int64), levels["size"].to_numpy(np.int64).copy()
        np.subtract.at(size, np.searchsorted(n, top["n"].to_numpy(np.int64)), 1)
        self.bands = Bands(groups * CLASSES, top["word"].to_numpy(np.int64), n[size > 0], size[size > 0])
        mass = table.mapInArrow(_masses(spark.sparkContext.broadcast(self.bands)), "klass int, mass double").groupBy("klass").agg(F.sum("mass").alias("mass")).toPandas()  # a row per class
        self.bands.mass[:] = 0
        self.bands.mass[mass["klass"].to_numpy(np.int64)] = mass["mass"].to_numpy(np.float64)
        self.bands.mass[-1] += 1  # for words not seen here
        self.klass, self.log_share = _Column(self, False), _Column(self, True)

    @property
    def classes(self) -> int:
        return self.bands.classes

    def code(self, slices: DataFrame, ws: Workspace) -> DataFrame:
        """The slices with each position's class and each text's summed log shares."""
        bands = slices.sparkSession.sparkContext.broadcast(self.bands)
        # Words meet their counts in parts of the range of hashes, as many as keep a part at about PART listed words.
        listed = slices.agg(F.sum(F.octet_length("own") / 8)).first()[0] or 0
        bits = max(0, int(np.ceil(np.log2(max(1.0, listed / PART)))))

        def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
            word, n = right.column("word").to_numpy(), right.column("n").to_numpy()
            order = np.argsort(word)
            word, n = word[order], n[order]
            k = bands.value.klass(word, n)
            # The last entry stands for words without a count.
            k, n = np.append(k, bands.value.classes - 1), np.append(n, 0)
            share, k = bands.value.log_share(k, n).astype(np.float32), k.astype(_narrow(bands.value.classes))
            out = []
            for own in left.column("own").to_pylist():
                own = np.frombuffer(own, np.int64)
                j = np.searchsorted(word, own)
                j[np.append(word, -1)[j] != own] = len(word)
                out.append((k[j].tobytes(), share[j].tobytes()))
            return pa.table({"slice": left.column("slice"), "part": left.column("part"), "klass": pa.array([x for x, _ in out], pa.binary()), "share": pa.array([x for _, x in out], pa.binary())})

        lists = slices.select("slice", "own").mapInArrow(_split(bits, bands), "slice long, part long, own binary")
        table = self.table.select(F.shiftright("word", 63 - bits).alias("part"), "word", "n")
        found = lists.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(look_up, "slice long, part long, klass binary, share binary")

        found = found.unionByName(slices.select("slice", "own").mapInArrow(_frequent(bands), "slice long, part long, klass binary, share binary"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("part")
            classes, shares = right.column("klass").to_pylist(), right.column("share").to_pylist()
            rest = np.frombuffer(b"".join(classes[1:]), _narrow(bands.value.classes))
            own = np.frombuffer(classes[0], _narrow(bands.value.classes))
            hit = np.unpackbits(np.frombuffer(shares[0], np.uint8), count=len(own) + len(rest)).astype(bool)
            k, share = np.empty(len(hit), rest.dtype), np.zeros(len(hit))
            k[hit], k[~hit] = own, rest
            share[~hit] = np.frombuffer(b"".join(shares[1:]), np.float32)
            first = np.frombuffer(left.column("first")[0].as_py(), np.int64)
            place = np.frombuffer(left.column("place")[0].as_py(), _narrow(len(k)))
            total = np.concatenate([[0.0], np.cumsum(share[place])])
            out = [k[place].tobytes(), (total[first[1:]] - total[first[:-1]]).tobytes()]
            return pa.table({"slice": left.column("slice"), "first": left.column("first"), "klass": pa.array(out[:1], pa.binary()), "share": pa.array(out[1:], pa.binary()), "body": left.column("body")})

        both = slices.select("slice", "first", "place", "body").groupBy("slice").cogroup(found.groupBy("slice"))
        return ws.stage(both.applyInArrow(run, "slice long, first binary, klass binary, share binary, body binary"), "coded")


class Network:
    """tanh of summed context embeddings, one table for each place in the window, then a softmax over groups and one over a group's classes."""

    def __init__(self, seed: int = 11, classes: int = CLASSES):
        rng = np.random.default_rng(seed)
        f = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        self.classes, self.groups = classes, classes // CLASSES
        self.p = [f(0.3, classes + 1, HIDDEN) for _ in range(2 * WINDOW)] + [f(0.25, HIDDEN, classes), np.zeros(classes, np.float32)]
        if self.groups > 1:
            self.p += [f(0.25, HIDDEN, self.groups), np.zeros(self.groups, np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p])

    def load(self, flat: np.ndarray) -> "Network":
        n = 0
        for i, x in enumerate(self.p):
            self.p[i] = flat[n : n + x.size].reshape(x.shape).astype(np.float32)
            n += x.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        x = self.p[0][context[0]]
        for place in range(1, 2 * WINDOW):
            x = x + self.p[place][context[place]]
        return np.tanh(x)

    def log_softmax(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden values and the log-probabilities of all classes."""
        h = self.hidden(context)
        w, b = self.p[2 * WINDOW : 2 * WINDOW + 2]
        s = _normal((h @ w + b).reshape(len(h), self.groups, CLASSES))
        if self.groups > 1:
            s = s + _normal(h @ self.p[-2] + self.p[-1])[:, :, None]
        return h, s.reshape(len(h), -1)

    def _levels(self, h: np.ndarray, target: np.ndarray):
        """Each softmax on the way to the targets: rows, the choice among its outcomes, weights, where these stand, log-probabilities."""
        w, b = self.p[2 * WINDOW : 2 * WINDOW + 2]
        group = target // CLASSES
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            rows, part = order[cuts[g] : cuts[g + 1]], slice(g * CLASSES, (g + 1) * CLASSES)
            yield rows, target[rows] - g * CLASSES, w[:, part], (2 * WINDOW, part), _normal(h[rows] @ w[:, part] + b[part])
        if self.groups > 1:
            yield np.arange(len(target)), group, self.p[-2], (2 * WINDOW + 2, slice(None)), _normal(h @ self.p[-2] + self.p[-1])

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The targets' log-probabilities; only the softmaxes on their ways are computed."""
        h = self.hidden(context)
        out = np.zeros(len(target), h.dtype)
        for rows, choice, _, _, s in self._levels(h, target):
            out[rows] += s[np.arange(len(rows)), choice]
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions, and its gradient."""
        h = self.hidden(context)
        n = len(target)
        loss, dh = 0.0, np.zeros_like(h)
        out = [np.zeros_like(x) for x in self.p]
        for rows, choice, w, (i, part), s in self._levels(h, target):
            every = np.arange(len(rows))
            loss -= float(s[every, choice].sum()) / n
            d = np.exp(s)
            d[every, choice] -= 1
            d /= n
            dh[rows] += d @ w.T
            out[i][:, part] = h[rows].T @ d
            out[i + 1][part] = d.sum(0)
        dx = (dh * (1 - h * h)).ravel()
        for place in range(2 * WINDOW):
            cell = context[place][:, None] * HIDDEN + np.arange(HIDDEN)
            out[place] = np.bincount(cell.ravel(), dx, (self.classes + 1) * HIDDEN).reshape(-1, HIDDEN).astype(h.dtype)
        return loss, out


def _normal(s: np.ndarray) -> np.ndarray:
    """Log-probabilities from scores over the last axis."""
    s = s - s.max(-1, keepdims=True)
    return s - np.log(np.exp(s).sum(-1, keepdims=True))


def contexts(klass: np.ndarray, first: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """Classes at the window's places around each position; the edge class beyond the own text."""
    n = len(klass)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for shift in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
        src = np.arange(n) + shift
        ok = (src >= 0) & (src < n)
        src = np.clip(src, 0, max(0, n - 1))
        ok &= row[src] == row if n else ok
        out.append(np.where(ok, klass[src] if n else src, edge))
    return np.stack(out)


def _coded(batch: pa.RecordBatch, classes: int) -> Iterator[list]:
    """Slice number, first positions and classes of each row, then its other columns."""
    for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
        yield [row[0], np.frombuffer(row[1], np.int64), np.frombuffer(row[2], _narrow(classes)).astype(np.int64), *row[3:]]


def _hash(klass: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's classes, in order."""
    n = np.diff(first)
    place = np.arange(len(klass)) - np.repeat(first[:-1], n)
    h = at.mix(klass.astype(np.uint64) + at.BASE * (place.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    return at.mix(total[first[1:]] - total[first[:-1]])


def _gradients(shared, r: int, rounds: int):
    """Each task's sum of gradients over the texts of round r, and of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, flat = shared.value
        net = Network(classes=classes).load(flat)
        total, seen = np.zeros(len(flat)), 0
        for batch in batches:
            for _, first, klass in _coded(batch, classes):
                mine = _hash(klass, first) % np.uint64(rounds) == r
                n = np.diff(first)
                klass, first = klass[np.repeat(mine, n)], np.concatenate([[0], np.cumsum(n[mine])])
                context = contexts(klass, first, classes)
                for a in range(0, len(klass), BATCH):
                    y = klass[a : a + BATCH]
                    _, g = net.gradient(context[:, a : a + BATCH], y)
                    total += np.concatenate([x.ravel() for x in g]).astype(np.float64) * len(y)
                    seen += len(y)
            at.give_back()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([math.isqrt(TaskContext.get().partitionId())], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([seen])], ["part", "total", "n"])

    return run


def _sum(tasks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of some tasks' gradients, batch by batch; groups and their members are as many as the root of the tasks."""
    total, seen = 0.0, 0
    for batch in tasks:
        for x in batch.column("total"):
            total = total + np.frombuffer(x.as_py(), np.float64)
        seen += sum(batch.column("n").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen])], ["total", "n"])


def train(coded: DataFrame, bands: Bands, rounds: int = ROUNDS, rate: float = 0.15) -> np.ndarray:
    """The network's weights after a step on each round's texts."""
    spark = coded.sparkSession
    net = Network(classes=bands.classes)
    mass = bands.mass.reshape(net.groups, CLASSES) + 1.0
    net.p[2 * WINDOW + 1] = np.log(mass / mass.sum(1, keepdims=True)).ravel().astype(np.float32)
    if net.groups > 1:
        net.p[-1] = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
    flat = net.flat().astype(np.float64)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    step = 0
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((bands.classes, flat.astype(np.float32)))
        sums = coded.select("slice", "first", "klass").mapInArrow(_gradients(shared, r, rounds), "part int, total binary, n long")
        g, seen = np.zeros_like(flat), 0
        for row in sums.groupBy("part").applyInArrow(_sum, "total binary, n long").toLocalIterator():  # as many as the root of the tasks
            g += np.frombuffer(row["total"], np.float64)
            seen += row["n"]
        if not seen:
            continue
        g /= seen
        step += 1
        m += 0.2 * (g - m)
        v += 0.1 * (g * g - v)
        fall = min(1.0, 2.0 * (1 - (r + 1) / (rounds + 1)))
        flat -= rate * fall * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.9**step)) + 1e-6)
        shared.destroy()
    return flat.astype(np.float32)


def _learn(spark: SparkSession, docs: DataFrame, text_col: str, kept: list[int], rounds: int) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    ws = Workspace(spark, "masked-lm")
    slices = cut(docs, text_col, kept, ws)
    vocab = Vocabulary(ws.stage(word_lists(slices).groupBy("word").agg(F.sum("n").alias("n")), "words"))
    coded = vocab.code(slices, ws)
    ws.drop(slices)
    return vocab, train(coded, vocab.bands, rounds), coded


def fit(spark: SparkSession, docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    return _learn(spark, docs.select(text_col), text_col, [], rounds)[:2]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, flat = shared.value
        net = Network(classes=classes).load(flat)
        for batch in batches:
            for number, first, klass, share, body in _coded(batch, classes):
                context = contexts(klass, first, classes)
                logp = np.zeros(len(klass))
                for a in range(0, len(klass), BATCH):
                    logp[a : a + BATCH] = net.log_prob(context[:, a : a + BATCH], klass[a : a + BATCH])
                total = np.concatenate([[0.0], np.cumsum(logp)])
                n = np.diff(first)
                pll = np.where(n > 0, total[first[1:]] - total[first[:-1]] + np.frombuffer(share, np.float64), 0.0)
                rows = pa.ipc.open_stream(body).read_next_batch()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n.astype(np.int64)), pa.array(pll), pa.array(np.full(len(n), number, np.int64)), pa.array(np.arange(len(n)))], names=[*rows.schema.names, "n_tokens", "pll", "_slice", "_row"])
            at.give_back()

    return run


def _scored(coded: DataFrame, rows: DataFrame, classes: int, flat: np.ndarray) -> DataFrame:
    """A row for each text of the coded slices: the kept columns, which are those of ``rows``, its scores, and where it stood."""
    zero = F.lit(0).cast("long")
    schema = rows.select("*", zero.alias("n_tokens"), F.lit(0.0).alias("pll"), zero.alias("_slice"), zero.alias("_row")).schema
    out = coded.mapInArrow(_score(coded.sparkSession.sparkContext.broadcast((classes, flat))), schema)
    return out.withColumn("mean_pll", F.try_divide("pll", "n_tokens"))


def score(spark: SparkSession, docs: DataFrame, model: tuple[Vocabulary, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, in their order, with n_tokens, pll (the summed log-probabilities) and mean_pll added, in place of columns of these names."""
    docs = docs.drop("n_tokens", "pll", "mean_pll")
    vocab, flat = model
    ws = Workspace(spark, "masked-lm-score")
    coded = vocab.code(cut(docs, text_col, list(range(len(docs.columns))), ws), ws)
    return _scored(coded, docs, vocab.classes, flat).orderBy("_slice", "_row").drop("_slice", "_row")


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocab, flat, coded = _learn(spark, docs, "text", [0], ROUNDS)
    return _scored(coded, docs.select("doc_id"), vocab.classes, flat).drop("_slice", "_row")
