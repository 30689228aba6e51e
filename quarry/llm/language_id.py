"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the running bytes of a text, in windows of up to ``WHOLE``
bytes: a text of that length or less is one window, a longer one is cut into
cores of ``CORE`` bytes, each read with ``CONTEXT`` bytes more on either side. Every
byte position gets a distribution over the languages from the states of both
directions, and a document's probabilities are the mean over all its positions;
those of a window's context count in the neighbouring window only.

Training is numpy backpropagation through time on the driver. It sees windows of
``SPAN`` bytes, up to ``SPANS`` of each of about ``TRAIN_DOCS`` labelled documents
chosen by hash, in equal parts of every language: the documented bound, which
also is that of the languages (one document each). Documents with
crc32(doc_id as text) mod 4 = 2 are held out. Predictions read whole texts and
nothing but the text.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without any training row every text is ``und``; a null lang is not learned;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import arrow_text as at

CORE, CONTEXT = 448, 32
WHOLE = CORE + 2 * CONTEXT
SPAN, SPANS = 64, 6
EMBED = 10
HIDDEN = 8
TRAIN_DOCS = 8_000
#: Windows that are read at a time.
BATCH = 2048
#: Fills up the few windows of training that are shorter than the others.
PAD = 0x20
UND = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs, one in each direction, and a softmax over the languages at every position.

    Gates of a GRU: update z, reset r and candidate c; h' = z h + (1 - z) c.
    """

    def __init__(self, classes: int, seed: int = 5, embed: int = EMBED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h, self.e, self.k = hidden, embed, classes
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"E": rng.normal(0, 0.5, (256, embed)).astype(np.float32), "O": f(2 * hidden, classes), "b": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(embed, 3 * hidden), f"U{d}": f(hidden, 2 * hidden), f"V{d}": f(hidden, hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}

    def _steps(self, x: np.ndarray, d: str, tape: list | None = None) -> Iterator[np.ndarray]:
        """The states after each step for windows of equal length: x is (windows, steps) of bytes, in reading order."""
        p, H = self.p, self.h
        table = p["E"] @ p[f"W{d}"] + p[f"c{d}"]
        h = np.zeros((len(x), H), np.float32)
        for byte in np.ascontiguousarray(x.T):
            g = table[byte]
            zr = _sigmoid(g[:, : 2 * H] + h @ p[f"U{d}"])
            z, r = zr[:, :H], zr[:, H:]
            rh = r * h
            c = np.tanh(g[:, 2 * H :] + rh @ p[f"V{d}"])
            if tape is not None:
                tape.append((h, z, r, rh, c))
            h = z * (h - c) + c
            yield h

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """All states, as (steps, windows, hidden), and what backpropagation needs."""
        tape: list = []
        states = np.empty((x.shape[1], len(x), self.h), np.float32)
        for t, h in enumerate(self._steps(x, d, tape if keep else None)):
            states[t] = h
        return states, tape

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(windows, steps, classes) probabilities."""
        f, _ = self._run(x, "f", False)
        b, _ = self._run(x[:, ::-1], "b", False)
        return np.stack([self._softmax(f[t], b[-1 - t]) for t in range(x.shape[1])], 1)

    def _softmax(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = f @ self.p["O"][: self.h] + b @ self.p["O"][self.h :] + self.p["b"]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        return s

    def states(self, x: np.ndarray, lens: np.ndarray, d: str) -> np.ndarray:
        """As ``_run`` for windows of falling lengths: step t has those that are longer than t, and nothing is filled up."""
        p, H = self.p, self.h
        table = p["E"] @ p[f"W{d}"] + p[f"c{d}"]
        # A sigmoid is a hyperbolic tangent of half the value.
        gates, cand, U, V = 0.5 * table[:, : 2 * H], table[:, 2 * H :].copy(), 0.5 * p[f"U{d}"], p[f"V{d}"]
        steps = x.shape[1]
        n = np.searchsorted(-lens, -np.arange(steps), "left")
        out = np.zeros((steps, len(x), H), np.float32)
        h = np.zeros((len(x), H), np.float32)
        bytes_ = np.ascontiguousarray(x.T)
        for t, a in enumerate(n.tolist()):
            h, byte = h[:a], bytes_[t, :a]
            zr = h @ U
            zr += gates[byte]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z = zr[:, :H]
            c = (zr[:, H:] * h) @ V
            c += cand[byte]
            np.tanh(c, out=c)
            h = np.subtract(h, c)
            h *= z
            h += c
            out[t, :a] = h
        return out

    def pooled(self, x: np.ndarray, lens: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Sums of the probabilities at the positions from first to before after, of windows of falling lengths."""
        steps = np.arange(x.shape[1])
        back = np.where(steps < lens[:, None], lens[:, None] - 1 - steps, 0)
        f, b = self.states(x, lens, "f"), self.states(np.take_along_axis(x, back, 1), lens, "b")
        front, rear, bias = self.p["O"][: self.h].T.copy(), self.p["O"][self.h :].T.copy(), self.p["b"][:, None]
        out = np.zeros((self.k, len(x)), np.float32)
        for t, a in enumerate(np.searchsorted(-lens, -steps, "left").tolist()):
            # Languages by windows, so that sums over languages run along whole rows.
            s = front @ f[t, :a].T
            s += rear @ b[lens[:a] - 1 - t, np.arange(a)].T
            s += bias
            s -= s.max(0)
            np.exp(s, out=s)
            s /= s.sum(0)
            inside = (first[:a] <= t) & (t < after[:a])
            out[:, :a] += s if inside.all() else s * inside
        return out.T

    def gradient(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the first n positions of each window, and its gradient through time."""
        p, H = self.p, self.h
        f, tape_f = self._run(x, "f", True)
        b, tape_b = self._run(x[:, ::-1], "b", True)
        both = np.concatenate([f, b[::-1]], 2)
        s = both @ p["O"] + p["b"]
        s -= s.max(-1, keepdims=True)
        s -= np.log(np.exp(s).sum(-1, keepdims=True))
        rows = np.arange(len(x))
        scale = ((np.arange(x.shape[1])[:, None] < n) / max(1, n.sum())).astype(np.float32)
        loss = float(-(s[:, rows, y] * scale).sum())
        ds = np.exp(s)
        ds[:, rows, y] -= 1
        ds *= scale[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["O"] = both.reshape(-1, 2 * H).T @ ds.reshape(-1, self.k)
        g["b"] = ds.sum((0, 1))
        dboth = ds @ p["O"].T
        for d, tape, xs, dout in (("f", tape_f, x, dboth[..., :H]), ("b", tape_b, x[:, ::-1], dboth[::-1, :, H:])):
            dh = np.zeros((len(x), H), np.float32)
            dg = np.empty((x.shape[1], len(x), 3 * H), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, rh, c = tape[t]
                dh = dh + dout[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                drh = dc @ p[f"V{d}"].T
                dr = drh * h * r * (1 - r)
                dg[t, :, :H], dg[t, :, H : 2 * H], dg[t, :, 2 * H :] = dz, dr, dc
                g[f"U{d}"] += h.T @ dg[t, :, : 2 * H]
                g[f"V{d}"] += rh.T @ dc
                dh = dh * z + drh * r + dg[t, :, : 2 * H] @ p[f"U{d}"].T
            byte = xs.T.ravel()
            dtable = np.stack([np.bincount(byte, dg[..., j].ravel(), 256) for j in range(3 * H)], 1).astype(np.float32)
            g[f"W{d}"] = p["E"].T @ dtable
            g["E"] += dtable @ p[f"W{d}"].T
            g[f"c{d}"] = dtable.sum(0)
        return loss, g


def filled(spans: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one size, filled up with spaces, and their own lengths."""
    x = np.full((len(spans), size), PAD, np.uint8)
    for row, s in zip(x, spans):
        row[: len(s)] = np.frombuffer(s, np.uint8)
    return x, np.array([len(s) for s in spans])


def train(spans: list[bytes], langs: np.ndarray, classes: int, steps: int = 200, batch: int = 256, rate: float = 0.012, seed: int = 5) -> Network:
    """Adam on batches of windows; all languages have the same share of them."""
    net, rng = Network(classes, seed), np.random.default_rng(seed)
    x, n = filled(spans, SPAN)
    by = [np.flatnonzero(langs == k) for k in range(classes)]
    some = np.array([k for k in range(classes) if len(by[k])])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, steps + 1):
        pick = some[rng.integers(0, len(some), batch)]
        rows = np.array([by[k][rng.integers(len(by[k]))] for k in pick])
        _, g = net.gradient(x[rows], langs[rows], n[rows])
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text, spread over it evenly."""
    for batch in batches:
        langs, spans = [], []
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = t.encode()
            k = max(1, min(SPANS, len(raw) // SPAN))
            starts = [j * (len(raw) - SPAN) // max(1, k - 1) for j in range(k)] if len(raw) > SPAN else [0]
            spans += [raw[a : a + SPAN] for a in starts]
            langs += [lang] * len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(spans, pa.binary())], ["lang", "span"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], Network | None]:
    """Languages in order, and the network, from documents that aren't held out and have a lang."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(train_docs).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], None
    # Each language gives up to its part of the bound.
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, train_docs / len(langs) / r["n"]) * (1 << 30))) for r in sizes], "lang string, share long")
    some = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share"))  # at most train_docs rows
    got = some.filter("text <> ''").select("lang", "text").mapInArrow(_spans, "lang string, span binary").distinct().toPandas()
    if not len(got):
        return langs, None
    got = got.sort_values(["lang", "span"])
    number = {x: i for i, x in enumerate(langs)}
    return langs, train(got["span"].tolist(), got["lang"].map(number).to_numpy(), len(langs))


def windows(t: at.Texts) -> tuple[np.ndarray, ...]:
    """Windows of a slice's texts: the text, where the window begins and ends in the slice, and which of its positions count."""
    n = np.diff(t.offsets)
    k = np.where(n > WHOLE, -(-n // CORE), np.minimum(n, 1))
    own = np.repeat(np.arange(len(t)), k)
    j = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
    long = n[own] > WHOLE
    core = np.where(long, j * CORE, 0)
    end = np.where(long, np.minimum(core + CORE, n[own]), n[own])
    begin = np.maximum(core - CONTEXT, 0)
    stop = np.minimum(end + CONTEXT, n[own])
    base = t.offsets[own]
    return own, base + begin, base + stop, core - begin, end - begin


def read(net: Network, t: at.Texts) -> np.ndarray:
    """Each text's sum of the probabilities at all its positions."""
    own, begin, stop, first, after = windows(t)
    out = np.zeros((len(t), net.k))
    order = np.argsort(begin - stop, kind="stable")
    size = min(BATCH, max(64, 64 * BATCH // net.k))  # fewer windows at a time for very many languages
    for a in range(0, len(order), size):
        w = order[a : a + size]
        lens = stop[w] - begin[w]
        x = t.data[np.minimum(begin[w, None] + np.arange(lens[0]), len(t.data) - 1)]
        np.add.at(out, own[w], net.pooled(x, lens, first[w], after[w]))
    return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(t: at.Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[t.data])])
    out = total[t.offsets[1:]] > total[t.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(t.offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _predict(text_at: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, net = shared.value
        for batch in batches:
            for t in at.slices(batch.column(text_at)):
                ok = _has_letter(t) & t.valid & (net is not None)
                best, score = np.zeros(len(t), np.int64), np.zeros(len(t))
                if net is not None and len(t.data):
                    prob = read(net, t) / np.maximum(np.diff(t.offsets), 1)[:, None]
                    best, score = prob.argmax(1), np.clip(prob.max(1), 0, 1)
                names = [langs[b] if o else UND for b, o in zip(best.tolist(), ok.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(t.first, len(t)) for c in range(batch.num_columns)] + [pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))], names=[*batch.schema.names, "lang_pred", "score"]
                )

    return run


def identify(spark: SparkSession, docs: DataFrame, model: tuple[list[str], Network | None], text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score added, in place of columns of these names."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(_predict(docs.columns.index(text_col), spark.sparkContext.broadcast(model)), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "lang", "text"))
    return identify(spark, docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
