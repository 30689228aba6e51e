"""Benchmark decontamination with a generalised suffix automaton.

Items are dealt by hash into blocks of about ``BLOCK_WORDS`` words. A task per
block builds its automaton, in flat arrays (a state's only or first transition)
and a dictionary for states with more; it is staged. Block by block it is then
broadcast; training words stream through it, and the length of the longest
suffix that occurs in an item is tracked word by word. A window (10
consecutive item words, or a whole shorter item) ends wherever that length
reaches it. With one block there is a single pass over the rows. Otherwise
rows are numbered and written once, each block's pass writes only the hits that
it finds, and these are joined with the rows at the end; so neither the driver
nor a worker holds more than one block. An item longer than a block is a block.

``spans`` are the merged runs of hit words as byte offsets into the text.
``clean`` removes spans of at least ``min_span`` words, and drops a document
whose hit words exceed ``max_coverage`` of all its words.

Defined cases: a null or wordless text has no words and no hits; items without
words have no windows; null items are ignored; equal item_ids count once;
extra columns pass through. An empty benchmark leaves every row clean.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import arrow_text as at
from quarry.plans.workspace import Workspace

WINDOW = 10
BLOCK_WORDS = 400_000

#: Bytes of words after lower-casing: digits, a-z, and all of UTF-8 beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = True
INSIDE[0x61:0x7B] = True
INSIDE[0x80:] = True


def _word_hashes(arr: pa.Array) -> Iterator[tuple[at.Texts, at.Words, np.ndarray]]:
    for t in at.slices(arr):
        t.data = at.LOWER[t.data]
        w = at.words(t, INSIDE)
        yield t, w, at.byte_hashes(t.data, w.starts, w.lens)


class Automaton:
    """A suffix automaton of several word sequences, with the items whose windows its states stand for.

    Words are numbers from 0 on. Lists over states are arrays of 32-bit integers.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.word, self.to = array("i", [-1]), array("i", [0])
        #: All transitions but the first, of states with several.
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        for _, seq in items:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.link)
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist()
        #: The state of the suffix of just ``window`` words, for states at least that long.
        self.at_window = array("i", bytes(4 * n))
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
        seen, own = array("i"), array("i")
        #: Short items that end in a state: (words, item).
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, (_, seq) in enumerate(items):
            v = size = 0
            for i, c in enumerate(seq):
                v, size = self.step(v, size, c)
                if i + 1 >= window:
                    seen.append(self.at_window[v])
                    own.append(number)
            if 0 < len(seq) < window:
                while self.length[self.link[v]] >= len(seq):
                    v = self.link[v]
                self.short.setdefault(v, []).append((len(seq), number))
        #: The items of each state of a window: from item_at[v] to item_at[v + 1].
        pairs = np.unique(np.frombuffer(seen, np.int32).astype(np.int64) * max(1, len(items)) + np.frombuffer(own, np.int32))
        self.item_of = (pairs % max(1, len(items))).astype(np.int32)
        self.item_at = np.searchsorted(pairs // max(1, len(items)), np.arange(n + 1)).astype(np.int32)
        #: The nearest state upwards, itself included, with short items.
        self.short_at = array("i", [-1]) * n
        for v in order:
            self.short_at[v] = v if v in self.short else self.short_at[self.link[v]]
        self.least = min([window, *(len(s) for _, s in items if s)])

    def target(self, v: int, c: int) -> int:
        """The state after one more word, or -1."""
        if self.word[v] == c:
            return self.to[v]
        found = self.more.get(v)
        return -1 if found is None else found.get(c, -1)

    def _set(self, v: int, c: int, to: int) -> None:
        if self.word[v] in (-1, c):
            self.word[v], self.to[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _extend(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        q = self.target(last, c)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(link)
        self.word.append(-1)
        self.to.append(0)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and (q := self.target(p, c)) < 0:
            self._set(p, c, cur)
            p = link[p]
        if p >= 0:
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.link)
        self.word.append(self.word[q])
        self.to.append(self.to[q])
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.target(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def step(self, v: int, size: int, c: int) -> tuple[int, int]:
        """From the state of the longest match of ``size`` words, that after one more word."""
        while (to := self.target(v, c)) < 0:
            if not v:
                return 0, 0
            v = self.link[v]
            size = self.length[v]
        return to, size + 1

    def stream(self, seq: list[int], base: int, hits: list[tuple[int, int]], items: set[int]) -> None:
        """Add the windows found in the sequence as (first, after last) word numbers, and their items."""
        v = size = 0
        window, at_window, short_at = self.window, self.at_window, self.short_at
        for i, c in enumerate(seq):
            v, size = self.step(v, size, c)
            if size >= window:
                hits.append((base + i + 1 - window, base + i + 1))
                w = at_window[v]
                items.update(self.item_of[self.item_at[w] : self.item_at[w + 1]].tolist())
            s = short_at[v]
            while s > 0:
                for n, number in self.short[s]:
                    if n <= size:
                        hits.append((base + i + 1 - n, base + i + 1))
                        items.add(number)
                s = short_at[self.link[s]]


def build(ids: list[str], texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, Automaton]:
    """The vocabulary (sorted word hashes) and automaton of items."""
    seqs: list[np.ndarray] = []
    for _, w, h in _word_hashes(texts):
        seqs += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *seqs]))
    return vocab, Automaton([(name, np.searchsorted(vocab, s).tolist()) for name, s in zip(ids, seqs)], window)


def _build(block: pa.Table) -> pa.Table:
    return pa.table({"block": block.column("block")[:1], "built": pa.array([pickle.dumps(build(block.column("id").to_pylist(), block.column("text").combine_chunks()))], pa.binary())})


def _blocks(bench: DataFrame, id_col: str, text_col: str, limit: int, ws: Workspace) -> DataFrame:
    """A staged row for each block of items: its number, and its pickled vocabulary and automaton."""
    rows = bench.select(bench[id_col].cast("string").alias("id"), bench[text_col].cast("string").alias("text")).filter("id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * limit)))  # a word and its separator take two characters at least
    return ws.stage(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(_build, "block int, built binary"), "blocks")


def _find(text_at: int, shared, all_rows: bool):
    """The rows with n_words, hits (word numbers) and items added; or only those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, auto = pickle.loads(shared.value)
        for batch in batches:
            for t, w, h in _word_hashes(batch.column(text_at)):
                known = np.zeros(len(h), bool)
                ids = np.zeros(len(h), np.int64)
                if len(vocab) and len(h):
                    ids = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                    known = vocab[ids] == h
                row_of = np.repeat(np.arange(len(t)), np.diff(w.first))
                cut = known.copy()
                cut[1:] &= ~(known[:-1] & (row_of[1:] == row_of[:-1]))
                begin = np.flatnonzero(cut)
                stop = known.copy()
                stop[:-1] &= ~(known[1:] & (row_of[1:] == row_of[:-1]))
                end = np.flatnonzero(stop) + 1
                hits: list[list] = [[] for _ in range(len(t))]
                items: list[set] = [set() for _ in range(len(t))]
                long = np.flatnonzero(end - begin >= auto.least)
                for r, a, b in zip(row_of[begin[long]].tolist() if len(long) else [], begin[long].tolist(), end[long].tolist()):
                    got: list[tuple[int, int]] = []
                    auto.stream(ids[a:b].tolist(), a - int(w.first[r]), got, items[r])
                    hits[r] += [x for pair in got for x in pair]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(t.first, len(t)) for c in range(batch.num_columns)]
                    + [pa.array(np.diff(w.first), pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted({auto.names[i] for i in x}) for x in items], pa.list_(pa.string()))],
                    names=[*batch.schema.names, "n_words", "hits", "items"],
                )
                yield out if all_rows else out.filter(pa.array([bool(x) for x in hits]))

    return run


def _count(text_at: int):
    """The rows with n_words put in before the last two columns, hits and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 2
            for t, w, _ in _word_hashes(batch.column(text_at)):
                part = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(np.diff(w.first), pa.int64()), *part.columns[k:]], names=[*part.schema.names[:k], "n_words", *part.schema.names[k:]])

    return run


def _merge(text_at: int):
    """The word numbers of hits as merged spans: words covered, span lengths in words, byte offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 3
            hits = batch.column(k + 1).to_pylist()
            n_hit, spans = [], []
            some = {i for i, x in enumerate(hits) if x}
            for i, x in enumerate(hits):
                merged: list[list[int]] = []
                for a, b in sorted(zip(x[::2], x[1::2])) if i in some else ():
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                n_hit.append(sum(b - a for a, b in merged))
                if merged:
                    t = next(at.slices(batch.column(text_at).slice(i, 1)))
                    t.data = at.LOWER[t.data]
                    w = at.words(t, INSIDE)
                    merged = [[b - a, int(w.starts[a]), int(w.starts[b - 1] + w.lens[b - 1])] for a, b in merged]
                spans.append([dict(zip(("n_words", "first", "after"), m)) for m in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in range(k + 1)]
                + [pa.array(n_hit, pa.int64()), batch.column(k + 2), pa.array(spans, pa.list_(pa.struct([("n_words", pa.int64()), ("first", pa.int64()), ("after", pa.int64())])))],
                names=[*batch.schema.names[: k + 1], "n_hit", "items", "spans"],
            )

    return run


def _then(first, second):
    """Both functions over the rows in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return second(first(batches))

    return run


def match(spark: SparkSession, docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows with n_words, n_hit, items (sorted ids) and spans added, in place of columns of these names."""
    docs = docs.drop("n_words", "n_hit", "items", "spans", "hits")
    ws = Workspace(spark, "decontamination")
    blocks = _blocks(bench, item_id, item_text, block_words, ws)
    text_at = docs.columns.index(text_col)
    empty = pickle.dumps(build([], pa.array([], pa.string())))
    built = lambda k: next((r["built"] for r in blocks.filter(F.col("block") == k).toLocalIterator()), empty)
    numbers = [r["block"] for r in blocks.select("block").orderBy("block").toLocalIterator()]
    if len(numbers) <= 1:
        rows, first = docs, _find(text_at, spark.sparkContext.broadcast(bytes(built(numbers[0] if numbers else 0))), True)
    else:
        rows = ws.stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        texts = rows.select("_row", text_col)
        found = []
        for k in numbers:
            shared = spark.sparkContext.broadcast(bytes(built(k)))
            hit = texts.mapInArrow(_find(1, shared, False), texts.select("*", *_nulls(n_words="long", hits="array<bigint>", items="array<string>")).schema)
            found.append(ws.stage(hit.select("_row", "hits", "items"), "hits"))
            shared.destroy()
        every = reduce(DataFrame.union, found).groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        every = ws.stage(every, "all-hits")
        for hits in found:
            ws.drop(hits)
        rows = rows.join(every, "_row", "left").select(*docs.columns, none(F.col("hits"), "array<bigint>").alias("hits"), none(F.col("items"), "array<string>").alias("items"))
        first = _count(text_at)
    last = docs.select("*", *_nulls(n_words="long", n_hit="long", items="array<string>", spans="array<struct<n_words:bigint,first:bigint,after:bigint>>")).schema
    return rows.mapInArrow(_then(first, _merge(text_at)), last)


def _nulls(**kinds: str) -> list[F.Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]


def clean(matched: DataFrame, text_col: str = "text", min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """Without spans of min_span words or more; documents with a larger share of hit words go."""
    kept = matched.filter(F.col("n_hit") <= F.lit(max_coverage) * F.greatest("n_words", F.lit(1)))
    cut = F.filter("spans", lambda s: s["n_words"] >= min_span)
    # Pieces between the removed spans, in bytes: from the end of one span to the start of the next.
    raw = F.encode(F.col(text_col), "UTF-8")
    firsts = F.concat(F.transform(cut, lambda s: s["first"]), F.array(F.octet_length(text_col).cast("long")))
    afters = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["after"]))
    pieces = F.transform(F.arrays_zip(afters.alias("a"), firsts.alias("b")), lambda p: F.decode(F.substr(raw, p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int")), "UTF-8"))
    return kept.withColumn(text_col, F.when(F.size(cut) > 0, F.array_join(pieces, "")).otherwise(F.col(text_col)))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = match(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM i),
p AS (SELECT DISTINCT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, w FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.k, p.pos, g.item_id FROM p JOIN g ON g.k = p.k AND g.g = array_to_string(p.w[p.pos:p.pos + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS x FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
