"""Chunks of texts, neighbour windows, page location and document types."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

SIZE, OVERLAP = 1800, 200
#: Numbers of the order column in a range of batches.
SPAN = 10_000
_SENTENCE = re.compile(r"(?<=[.!?])(?=\s+[A-Z\"'(])|(?<=\n)")

# Phrases that mark a document's type, with their weights; categories in order of precedence.
MARKERS = {
    "Invoice": {"tax invoice": 10, "freelance invoice": 10, "proforma invoice": 10, "invoice no": 8, "invoice #": 8, "invoice number": 8, "bill to": 5, "invoice": 3},
    "Bank statement": {"bank statement": 10, "account statement": 10, "statement of account": 10, "opening balance": 4, "closing balance": 4, "neft": 2, "imps": 2},
    "Salary slip": {"salary slip": 10, "pay slip": 10, "payslip": 10, "net pay": 5, "gross pay": 4, "earnings": 2, "deductions": 2},
    "Tax & GST": {"goods and services tax": 10, "gst return": 10, "gstr-3b": 10, "gstr 3b": 10, "form gstr": 10, "income tax": 8, "form 16": 8, "tds certificate": 8, "cgst": 3, "sgst": 3, "taxable value": 2, "return period": 2},
    "Purchase order": {"purchase order": 10, "po number": 8, "p.o. no": 8, "order no": 4},
    "Receipt": {"rent receipt": 10, "payment receipt": 10, "received with thanks": 8, "received from": 5, "receipt": 4},
    "Bill": {"electricity bill": 10, "utility bill": 10, "water bill": 10, "gas bill": 10, "phone bill": 10, "mobile bill": 10, "bill month": 5, "units consumed": 4, "amount payable": 3},
    "Notice": {"compliance notice": 10, "legal notice": 10, "renewal notice": 10, "show cause": 10, "licence renewal": 8, "license renewal": 8, "notice": 3, "response required": 3},
    "Contract": {"supply agreement": 10, "vendor contract": 10, "service agreement": 10, "lease agreement": 10, "rental agreement": 10, "inter-party settlement": 10, "settlement": 6, "contract value": 6, "lease": 5, "agreement": 3, "terms and conditions": 3},
    "ID": {"aadhaar": 10, "aadhar": 10, "passport": 10, "pan card": 10, "permanent account number": 8, "driving licence": 10, "driving license": 10, "voter id": 10, "government of india": 6, "uidai": 8},
    "Resume": {"curriculum vitae": 10, "work experience": 8, "resume": 8, "professional experience": 6},
    "Travel": {"travel itinerary": 10, "flight booking": 10, "boarding pass": 10, "e-ticket": 10, "itinerary": 6, "visa": 6, "pnr": 5, "departure": 3},
}
# Fixed values end.
ANCHOR, LEAST_SCORE, SAMPLE = 8, 4, 4000


def with_doc_type(docs: DataFrame, name_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """doc_type added: the category of the best score; "Other" without an anchor phrase or below the least score.

    A phrase in the name weighs 3 more and is an anchor. The phrases are a
    literal array that each row filters for those it has, so there is no join.
    """
    marks = F.array(*(F.struct(F.lit(order).alias("ord"), F.lit(p).alias("phrase"), F.lit(w).alias("w")) for order, ps in enumerate(MARKERS.values()) for p, w in ps.items()))
    content = F.lower(F.substr(F.coalesce(F.col(text_col), F.lit("")), F.lit(1), F.lit(sample)))
    spaced = F.lower(F.regexp_replace(T.split_camel(F.coalesce(F.col(name_col), F.lit(""))), r"[-_./]+", " "))
    d = docs.withColumn("__content", content).withColumn("__spaced", spaced)
    inside, named = (lambda m: F.col("__content").contains(m["phrase"])), (lambda m: F.col("__spaced").contains(m["phrase"]))
    found = F.filter(marks, lambda m: inside(m) | named(m))
    points = F.transform(found, lambda m: F.struct(m["ord"].alias("ord"), (F.when(inside(m), m["w"]).otherwise(0) + F.when(named(m), m["w"] + 3).otherwise(0)).alias("points"), (named(m) | (m["w"] >= ANCHOR)).alias("anchor")))
    d = d.withColumn("__points", points)
    own = lambda k: F.filter("__points", lambda x: x["ord"] == k)
    score = F.transform(F.array_distinct(F.transform("__points", lambda x: x["ord"])), lambda k: F.struct(F.when(F.exists(own(k), lambda x: x["anchor"]), F.aggregate(own(k), F.lit(0), lambda s, x: s + x["points"])).otherwise(0).alias("score"), (-k).alias("order")))
    d = d.withColumn("__best", F.array_max(score))
    labels = F.array(*map(F.lit, MARKERS))
    label = F.when(F.col("__best.score") >= LEAST_SCORE, F.get(labels, -F.col("__best.order"))).otherwise("Other")
    return d.withColumn("doc_type", label).drop("__content", "__spaced", "__points", "__best")


def sentences(text: str) -> list[str]:
    out = []
    for paragraph in re.split(r"\n\n+", text):
        out += [s for s in (p.strip() for p in _SENTENCE.split(paragraph.strip())) if s]
    return out


def pack(parts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole sentences up to a size; each begins so far back that it overlaps the last, and always advances."""
    lens = [len(p) for p in parts]
    out, begin, n = [], 0, len(parts)
    while begin < n:
        end, used = begin + 1, lens[begin]
        while end < n and used + 1 + lens[end] <= size:
            used += 1 + lens[end]
            end += 1
        out.append(" ".join(parts[begin:end]))
        if end >= n:
            break
        back, at = 0, end - 1
        while at > 0 and back < overlap:
            back += lens[at] + 1
            at -= 1
        begin = max(at + 1, begin + 1)
    return out


def chunk(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, total_chunks, text): where a chunk begins depends on the last one's end, so this is Arrow-batched Python."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in zip(f[id_col], f[text_col]):
                got = pack(sentences(t or ""), size, overlap)
                rows += [(i, k, len(got), c) for k, c in enumerate(got) if c.strip()]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "total_chunks", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_index int, total_chunks int, text string")


def neighbours(chunks: DataFrame, file_col: str, hit: Column, most: int = 40, chars: int = 100_000) -> DataFrame:
    """Runs of chunks that are hits or next to one, joined by newlines, within caps on runs and characters per file."""
    w = W.partitionBy(file_col).orderBy("chunk_index")
    c = chunks.withColumn("hit", hit).withColumn("near", F.max("hit").over(w.rowsBetween(-1, 1))).filter("near")
    c = c.withColumn("new", F.coalesce((F.col("chunk_index") - F.lag("chunk_index").over(w)) > 1, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = c.groupBy(file_col, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("chunks"))
    order = W.partitionBy(file_col).orderBy("run")
    before = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("before", before).filter((F.col("run") <= most) & (F.col("before") < chars)).drop("before")


def leading(chunks: DataFrame, file_col: str, budget: int) -> DataFrame:
    """A file's first chunks until a budget of characters (a newline each) is used; the last may pass it."""
    w = W.partitionBy(file_col).orderBy("chunk_index")
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("before", before).filter(F.col("before") < budget).drop("before")


def batches(docs: DataFrame, group_col: str, order_col: str, size_col: str, most_chars: int, most_docs: int, span: int = SPAN) -> DataFrame:
    """Greedy batches: a new one where the next document would exceed the characters or the count.

    A batch depends on the one before it, so this is a fold. Each group is cut into ranges of ``span`` numbers of its
    order column, and batches begin anew in each: a task folds one range, however large the group. Rows are
    (group, order, range, batch); batches count from 0 in each range.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (group_col, order_col)}

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order_col)
        number, used, count, out = 0, 0, 0, []
        for n in f[size_col].fillna(0):
            if count and (used + n > most_chars or count >= most_docs):
                number, used, count = number + 1, 0, 0
            used, count = used + n, count + 1
            out.append(number)
        return pd.DataFrame({group_col: f[group_col], order_col: f[order_col], "range": f["range"], "batch": out})

    rows = docs.select(group_col, order_col, size_col, F.floor(F.col(order_col) / span).cast("long").alias("range"))
    return rows.groupBy(group_col, "range").applyInPandas(run, f"{group_col} {kinds[group_col]}, {order_col} {kinds[order_col]}, range long, batch int")


#: Pages and chunks of a file that a task holds at a time; bytes of pages that are looked through at a time.
PAGE_PART, CHUNK_PART, SLICE = 2_000, 20_000, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All strings of a column as bytes, and where each begins (and the last one ends)."""
    arr = pa.concat_arrays(column.cast(pa.string()).chunks)
    at = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(arr.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _edges(t: pa.Table) -> np.ndarray:
    """Where the groups of a sorted table begin."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for name in ("file", "p", "c"):
        col = pa.concat_arrays(t.column(name).chunks)
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        new[1:] |= np.asarray(pc.coalesce(pc.not_equal(a, b), pc.not_equal(a.is_null(), b.is_null())))
    return np.flatnonzero(new)


class _Pages:
    """The pages of several groups, up to SLICE bytes; windows of any length are found by the differences of rolling hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: np.ndarray, inverse: np.ndarray):
        self.data, self.starts, self.ends, self.power = data, starts, ends, power
        # prefix[i + 1] = prefix[i] * base + code[i]: as sums of codes over falling powers, by the inverse of the base.
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        self.prefix[1:] = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[1 : len(data) + 1], dtype=np.uint64) * power[1 : len(data) + 1]

    def find(self, probes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last place of each probe (a row of bytes) in its group; -1 if there is none."""
        n = probes.shape[1]
        own = ((probes.astype(np.uint64) + np.uint64(1)) * self.power[n - 1 :: -1][:n]).sum(1, dtype=np.uint64) + group.astype(np.uint64) * _SALT
        keys, key = np.unique(own, return_inverse=True)
        groups = np.unique(group)
        count = np.maximum(0, self.ends[groups] - self.starts[groups] - n)  # a page's last byte ends it
        at = np.repeat(self.starts[groups] - np.cumsum(count) + count, count) + np.arange(count.sum())
        h = self.prefix[at + n] - self.prefix[at] * self.power[n] + np.repeat(groups.astype(np.uint64) * _SALT, count)
        likely = np.zeros(1 << 16, bool)
        likely[keys >> np.uint64(48)] = True
        some = np.flatnonzero(likely[h >> np.uint64(48)])
        which = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
        hit = keys[which] == h[some]
        at, which = at[some[hit]], which[hit]
        first, last = np.full(len(keys), len(self.data)), np.full(len(keys), -1)
        np.minimum.at(first, which, at)
        np.maximum.at(last, which, at)
        first, last = first[key], last[key]
        found = np.flatnonzero(last >= 0)
        same = np.ones(len(found), bool)
        for place in (first, last):
            same &= (self.data[place[found][:, None] + np.arange(n)] == probes[found]).all(1)
        first[last < 0] = -1
        for i in found[~same]:  # other bytes of an equal hash
            g, raw = group[i], self.data.tobytes()
            first[i], last[i] = (f(probes[i].tobytes(), self.starts[g], self.ends[g]) for f in (raw.find, raw.rfind))
        return first, last


def _in_groups(t: pa.Table, edges: np.ndarray, sizes: list[int], power: np.ndarray, inverse: np.ndarray) -> pa.RecordBatch:
    """First and last pages of each probe's head and tail in its group's pages, by size: -1 if there is none, or if a longer one was found."""
    number = t.column("number").fill_null(-1).to_numpy()
    own = np.flatnonzero(t.column("side").to_numpy() == 1)
    group = np.searchsorted(edges, own, "right") - 1
    data, at = _bytes(t.column("page_text"))
    starts, ends = at[edges], np.append(at[edges[1:]], at[-1])
    most = max(sizes)
    sides, column = [], np.arange(most)
    for name in ("head", "tail"):
        raw, begin = _bytes(t.column(name))
        lens = np.diff(begin)[own]
        rows = np.zeros((len(own), most), np.uint8)
        rows[column < lens[:, None] if name == "head" else column >= most - lens[:, None]] = raw
        sides.append(rows)
    places = [np.full((len(own), len(sizes)), -1) for _ in sides]

    def look(part: list[int], a: int, z: int) -> None:
        """Look for the probes of some groups between two places."""
        lo, hi = np.searchsorted(group, [part[0], part[-1] + 1])
        pages = _Pages(data[a:z], np.maximum(starts[part[0] : part[-1] + 1], a) - a, np.minimum(ends[part[0] : part[-1] + 1], z) - a, power, inverse)
        todo = [np.flatnonzero(lens[lo:hi]) + lo] * 2
        for k, n in enumerate(sizes):
            cut = [x[lens[x] > n] for x in todo] if k else todo  # shorter ones were looked for as a whole
            for size in np.unique(np.minimum(lens[np.concatenate(cut)], n)):
                heads, tails = (x[np.minimum(lens[x], n) == size] for x in cut)
                f, e = pages.find(np.concatenate([sides[0][heads, :size], sides[1][tails, most - size :]]), group[np.concatenate([heads, tails])] - part[0])
                f, e = f[: len(heads)], e[len(heads) :]
                for kept, x, spot, pick in zip(places, (heads, tails), (f, e), (np.minimum, np.maximum)):
                    ok, x = spot >= 0, x[spot >= 0]
                    kept[x, k] = np.where(kept[x, k] < 0, spot[ok] + a, pick(kept[x, k], spot[ok] + a))
            todo = [x[kept[x, k] < 0] for x, kept in zip(todo, places)]

    g = 0
    while g < len(edges):
        a, z = starts[g], g + 1
        while z < len(edges) and ends[z] - a <= SLICE:
            z += 1
        for b in range(int(a), int(ends[z - 1]), SLICE):  # a group beyond the size is looked through in overlapping pieces
            look(list(range(g, z)), b, min(int(ends[z - 1]), b + SLICE + most + 1))
        g = z
    lists = [np.where(x >= 0, number[np.searchsorted(at, x, "right") - 1], -1).tolist() for x in places]
    own = own[lens > 0] if (drop := not lens.all()) else own
    lists = [[x for x, n in zip(y, lens) if n] for y in lists] if drop else lists
    named = t.select(["file", "number"]).take(pa.array(own))
    return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in named.columns), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["file", "chunk_index", "first", "last"])


def _locate(sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, a group's pages first; a group that a batch may not end is held back."""
        power, inverse = (_powers(x, SLICE + max(sizes) + 1) for x in (_BASE, _INVERSE))
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            edges = _edges(t)
            if len(edges) > 1:
                yield _in_groups(t.slice(0, edges[-1]), edges[:-1], sizes, power, inverse)
            rest = t.slice(edges[-1])
        if rest is not None:
            yield _in_groups(rest, np.zeros(1, np.int64), sizes, power, inverse)

    return run


def locate_pages(chunks: DataFrame, pages: DataFrame, file_col: str, probe: int = 60, step: int = 16) -> DataFrame:
    """page_start and page_end of chunks, by looking up their first and last letters and digits on the file's pages.

    The probe shrinks until it is found; chunks that aren't found have nulls. A task meets a part of a file's pages with
    a part of its chunks' probes. Rows are sorted by these parts, and many files are looked through together by rolling
    hashes, so work grows with the text and not with pages times chunks, nor with the number of files; parts of one file
    are put together by an aggregation.
    """
    # Without filters: they would squash every text once more. Empty probes are left out later.
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    sizes = list(range(probe, 0, -step))
    kind = chunks.schema[file_col].dataType.simpleString()
    p = pages.select(F.col(file_col).alias("file"), F.col("page").cast("long").alias("number"), "text").filter("number is not null and text is not null")
    c = chunks.select(F.col(file_col).alias("file"), F.col("chunk_index").cast("long").alias("number"), "text").filter("text is not null")
    p = p.withColumn("p", F.floor(F.col("number") / PAGE_PART).cast("int"))
    c = c.withColumn("c", F.floor(F.col("number") / CHUNK_PART).cast("int"))
    most = p.agg(F.max("p")).first()[0] or 0, c.agg(F.max("c")).first()[0] or 0
    p, c = p.withColumn("flat", squash(F.col("text"))), c.withColumn("flat", squash(F.col("text")))
    p = p.select("file", "p", F.lit(0).alias("side"), "number", F.concat("flat", F.lit("\n")).alias("page_text"), F.lit("").alias("head"), F.lit("").alias("tail"))
    tail = F.substr("flat", F.greatest(F.length("flat") - probe + 1, F.lit(1)))
    c = c.select("file", "c", F.lit(1).alias("side"), "number", F.lit("").alias("page_text"), F.substr("flat", F.lit(1), F.lit(probe)).alias("head"), tail.alias("tail"))
    if any(most):
        # Files of several parts: each part of the pages meets each part of the chunks.
        p_of, c_of = p.select("file", "p").distinct(), c.select("file", "c").distinct()
        # Named anew, as both sides have columns of one origin.
        p, c = (d.select(*(F.col(x).alias(x) for x in d.columns)) for d in (p.join(c_of, "file"), c.join(p_of, "file")))
    else:
        p, c = p.withColumn("c", F.lit(0)), c.withColumn("p", F.lit(0))
    rows = p.unionByName(c).repartition("file", "p", "c").sortWithinPartitions("file", "p", "c", "side", "number")
    found = rows.mapInArrow(_locate(sizes), f"file {kind}, chunk_index long, first array<bigint>, last array<bigint>")
    seen = lambda a, k: F.when(F.get(a, F.lit(k)) >= 0, F.get(a, F.lit(k)))
    each = [F.min(seen("first", k)).alias(f"f{k}") for k in range(len(sizes))] + [F.max(seen("last", k)).alias(f"l{k}") for k in range(len(sizes))]
    best = found.groupBy("file", "chunk_index").agg(*each)
    return best.select(F.col("file").alias(file_col), "chunk_index", *(F.coalesce(*(F.col(f"{x}{k}") for k in range(len(sizes)))).alias(name) for x, name in (("f", "page_start"), ("l", "page_end"))))
