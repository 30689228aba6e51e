"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes of a text.

Exact-text deduplication comes first: the documents are shuffled by their full
text, each distinct text is tokenised and aligned once and carries the number
of its documents, pair counts are sums of these numbers, and the measures are
joined to the doc_ids by the text's SHA-256.

Tokens: A is a byte-level BPE over space + text, B a byte-fallback piece model
over text (it puts a space before it itself). Both end a token wherever a run
of spaces begins after a character that is not white space, so a slice of texts
is cut there and each distinct segment of the slice is encoded and aligned
once; a text's tokens are those of its segments in a row.

The table of pair counts grows with the vocabularies, not with the documents,
but its bound (their product) is too large to broadcast unseen: it is counted,
and dealt into blocks of at most ``PAIR_BLOCK`` pairs by the A id, each of which
is broadcast to a pass over the staged pair lists.

Defined cases: null, empty and unfaithful texts (the bytes of A's or B's tokens
differ from space + text, as with a literal U+2581) have no tokens: zeros, and
an empty ``groups_sha256``; they count for no pair. Repeated rows and repeated
doc_ids each count as a document and each get a row. Of extra columns none is
carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm import arrow_text as at
from quarry.plans.workspace import Workspace

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
#: A pair's code is its A id times this plus its B id.
B_IDS = 1 << 15
#: Pairs of one broadcast block (24 bytes each in the hash table of a join).
PAIR_BLOCK = 1_000_000
#: Bytes of text that are segmented and encoded together.
SLICE = 4 << 20
#: Above this many links a group is counted by distinct ids and not link by link.
WIDE_GROUP = 100_000


@cache
def _byte_level() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Each id's bytes, flat."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.lens[ids]
        total = int(n.sum())
        return self.data[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(total)]


@cache
def _a(path: str):
    """The A tokenizer and its vocabulary.

    The file's vocabulary is handed to a faster library, which knows no merges
    but merges by rank; so every merge must have made the next id.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, back = spec["model"], _byte_level()
    special = {t["id"] for t in spec["added_tokens"]}
    spelt = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if i not in special}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(spelt):
        raise ValueError(f"the ids of {path} aren't in the order of its merges")
    t = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in spelt.items()}, special_tokens={})
    return t, Vocabulary([spelt.get(i, b"") for i in range(max(spelt) + 1)])


@cache
def _b(path: str):
    """The B model and its vocabulary."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    size = p.get_piece_size()
    if size > B_IDS:
        raise ValueError(f"{path} has {size} pieces; a pair's code has room for {B_IDS}")
    piece = lambda i: bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
    pieces = [p.id_to_piece(i) for i in range(size)]
    if any("▁" in x.lstrip("▁") for x in pieces):
        raise ValueError(f"{path} has pieces that cross the beginning of a word")
    return p, Vocabulary([piece(i) for i in range(size)])


def segment_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where texts and their segments begin: a space whose predecessor is neither a space nor other white space."""
    n = len(data)
    cut = np.zeros(n, bool)
    cut[1:] = (data[1:] == 0x20) & (data[:-1] > 0x20)
    # Unicode's other white space ends in bytes after 0xC2, or two bytes after 0xE1 to 0xE3: no cut after such characters.
    cut[2:] &= data[:-2] != 0xC2
    cut[3:] &= (data[:-3] < 0xE1) | (data[:-3] > 0xE3)
    cut[begins] = True
    return np.flatnonzero(cut)


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of first[1], and so on."""
    total = int(n.sum())
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)


def _distinct(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct run of bytes, and each run's number among them."""
    h = at.byte_hashes(data, starts, lens)
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    same = np.array_equal(lens[one][number], lens) and np.array_equal(data[_ragged(starts[one][number], lens)], data[_ragged(starts, lens)])
    if not same:  # two runs of one hash: go by the bytes themselves
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        number = np.array([seen.setdefault(raw[s : s + n], len(seen)) for s, n in zip(starts.tolist(), lens.tolist())])
        _, one = np.unique(number, return_index=True)
    return one, number


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _joined(strings: pa.Array, n: np.ndarray, sep: str) -> pa.Array:
    """The strings, n[0] of them joined, then n[1], and so on."""
    bounds = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(bounds, strings), pa.scalar(sep, pa.large_string()))


class Segments:
    """Distinct segments, aligned: counts, links and the digest's text of each."""

    def __init__(self, texts: list[bytes], a_path: str, b_path: str):
        (a, va), (b, vb) = _a(a_path), _b(b_path)
        strings = [t.decode() for t in texts]
        a_ids, self.n_a = _flat([a.encode_ordinary(s) for s in strings])
        alone = [b.piece_to_id("▁")]  # of an empty text B gives nothing, not even the space
        b_ids, self.n_b = _flat([x if s != " " else alone for x, s in zip(b.encode([s[1:] for s in strings], num_threads=1), strings)])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.faithful = self._equal(raw, size, va, a_ids, self.n_a) & self._equal(raw, size, vb, b_ids, self.n_b)
        if not self.faithful.all():  # segments whose tokens spell something else have none
            a_ids, b_ids = a_ids[np.repeat(self.faithful, self.n_a)], b_ids[np.repeat(self.faithful, self.n_b)]
            self.n_a, self.n_b, size = self.n_a * self.faithful, self.n_b * self.faithful, size * self.faithful
        end_a, end_b = np.cumsum(va.lens[a_ids]), np.cumsum(vb.lens[b_ids])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
        first_a, first_b = np.concatenate([[0], last_a[:-1]]), np.concatenate([[0], last_b[:-1]])
        na, nb = last_a - first_a, last_b - first_b
        of = np.searchsorted(np.cumsum(size), both)
        k = len(texts)
        self.n_groups = np.bincount(of, minlength=k)
        self.n_links = np.bincount(of, weights=na * nb, minlength=k).astype(np.int64)
        decimal = lambda ids, n: _joined(pa.array(ids).cast(pa.large_string()), n, ",")
        groups = pc.binary_join_element_wise(decimal(a_ids, na), decimal(b_ids, nb), pa.scalar("|", pa.large_string()))
        self.digest = _joined(groups, self.n_groups, ";")
        wide = na * nb > WIDE_GROUP
        n = np.where(wide, 0, na * nb)
        g = np.repeat(np.arange(len(both)), n)
        r = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
        self.codes = a_ids[first_a[g] + r // nb[g]] * B_IDS + b_ids[first_b[g] + r % nb[g]]
        self.times = np.ones(len(g), np.int64)
        seg = of[g]
        for w in np.flatnonzero(wide).tolist():  # few: long runs without a common end
            ua, ca = np.unique(a_ids[first_a[w] : last_a[w]], return_counts=True)
            ub, cb = np.unique(b_ids[first_b[w] : last_b[w]], return_counts=True)
            self.codes = np.concatenate([self.codes, np.add.outer(ua * B_IDS, ub).ravel()])
            self.times = np.concatenate([self.times, np.outer(ca, cb).ravel()])
            seg = np.concatenate([seg, np.full(len(ua) * len(ub), of[w])])
        if wide.any():
            order = np.argsort(seg, kind="stable")
            self.codes, self.times, seg = self.codes[order], self.times[order], seg[order]
        self.n_codes = np.bincount(seg, minlength=k)
        self.first_code = np.cumsum(self.n_codes) - self.n_codes

    @staticmethod
    def _equal(raw: np.ndarray, size: np.ndarray, v: Vocabulary, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes of each segment's tokens are the segment's."""
        spelt = v.bytes_of(ids)
        total = np.concatenate([[0], np.cumsum(v.lens[ids])])
        bounds = total[np.concatenate([[0], np.cumsum(n)])]
        if np.array_equal(np.diff(bounds), size):
            if np.array_equal(spelt, raw):
                return np.ones(len(size), bool)
            differs = np.concatenate([[0], np.cumsum(spelt != raw)])
            return differs[bounds[1:]] == differs[bounds[:-1]]
        at_ = np.concatenate([[0], np.cumsum(size)])
        x, y = spelt.tobytes(), raw.tobytes()
        return np.array([x[p:q] == y[s:t] for p, q, s, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), at_[:-1].tolist(), at_[1:].tolist())], bool)


def align_slice(texts: list[str], a_path: str = A_FILE, b_path: str = B_FILE) -> dict[str, list | pa.Array]:
    """Of each text (not empty): counts of tokens, groups and links, the digest, and its distinct pairs with their links."""
    raw = [b" " + t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = np.cumsum(size) - size
    starts = segment_starts(data, begins)
    lens = np.diff(np.concatenate([starts, [len(data)]]))
    of = np.searchsorted(begins, starts, "right") - 1
    one, number = _distinct(data, starts, lens)
    flat = data.tobytes()
    segs = Segments([flat[s : s + n] for s, n in zip(starts[one].tolist(), lens[one].tolist())], a_path, b_path)
    k = len(texts)
    good = np.bincount(of, weights=~segs.faithful[number], minlength=k) == 0
    # A literal U+2581 is taken for a space by B: such texts are found unfaithful above, segment by segment.
    keep = good[of]
    of, number = of[keep], number[keep]
    total = lambda x: np.bincount(of, weights=x[number], minlength=k).astype(np.int64)
    joined = _joined(segs.digest.take(pa.array(number)), np.bincount(of, minlength=k), ";")
    # Distinct pairs by (text, code).
    n = segs.n_codes[number]
    places = _ragged(segs.first_code[number], n)
    key = np.repeat(of, n) << 31 | segs.codes[places]
    if (segs.times == 1).all():
        key, times = np.unique(key, return_counts=True)
    else:
        key, back = np.unique(key, return_inverse=True)
        times = np.bincount(back, weights=segs.times[places]).astype(np.int64)
    bounds = np.searchsorted(key >> 31, np.arange(k + 1))
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))
    return {
        "n_a": total(segs.n_a), "n_b": total(segs.n_b), "n_groups": total(segs.n_groups), "n_links": total(segs.n_links),
        "groups_sha256": [hashlib.sha256(s.as_buffer()).hexdigest() if ok else "" for s, ok in zip(joined, good.tolist())],
        "pairs": lists(key & (2**31 - 1), pa.int32()), "times": lists(times, pa.int64()),
    }


MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = batch.column(0), np.asarray(batch.column(1))
            size = np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))
            first = 0
            while first < len(text):
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE, "right")))
                part = text.slice(first, last - first)
                m = align_slice(part.to_pylist(), a_path, b_path)
                sha = pa.array([hashlib.sha256(s.as_buffer()).digest() for s in part], pa.binary())
                yield pa.RecordBatch.from_arrays([sha, pa.array(n[first:last], pa.int64()), *(pa.array(x) if not isinstance(x, pa.Array) else x for x in m.values())], names=["text_sha", "n_docs", *m])
                first = last
        at.give_back()

    return run


def align_texts(docs: DataFrame, text_col: str = "text", a_path: str = A_FILE, b_path: str = B_FILE) -> DataFrame:
    """A row for each distinct text that isn't empty: its SHA-256, its number of documents, measures, pairs and their links."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n_docs"))
    return texts.mapInArrow(_aligned(a_path, b_path), f"text_sha binary, n_docs long, {MEASURES}, pairs array<int>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, n, best): how many documents hold a pair linked, and whether no other pair of its A id has more."""
    n = aligned.select(F.explode("pairs").alias("pair"), "n_docs").groupBy("pair").agg(F.sum("n_docs").alias("n"))
    n = n.withColumn("a", F.shiftright("pair", B_IDS.bit_length() - 1))
    return n.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("a")))


def _blocks(counts: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of A ids of at most ``limit`` pairs (an A id has at most 32,768)."""
    sizes = sorted((r["a"], r["n"]) for r in counts.groupBy("a").agg(F.count("*").alias("n")).collect())  # a row per A id
    out, first, total = [], 0, 0
    for a, n in sizes:
        if total and total + n > limit:
            out, first, total = [*out, (first, a)], a, 0
        total += n
    return [*out, (first, 1 << 31)]


def align(spark: SparkSession, docs: DataFrame, text_col: str = "text", a_path: str = A_FILE, b_path: str = B_FILE, block: int = PAIR_BLOCK) -> DataFrame:
    """doc_id and its measures: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    ws = Workspace(spark, "alignment")
    aligned = ws.stage(align_texts(docs, text_col, a_path, b_path).withColumn("tid", F.monotonically_increasing_id()), "aligned")
    counts = ws.stage(pair_counts(aligned), "pairs")
    sums = None
    links = aligned.select("tid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    for lo, hi in _blocks(counts, block):
        known = F.broadcast(counts.filter((F.col("a") >= lo) & (F.col("a") < hi)).select("pair", "n", "best"))
        part = links.join(known, "pair").groupBy("tid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("tid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = ws.stage(aligned.drop("pairs", "times", "n_docs").join(sums, "tid", "left").drop("tid"), "measures")
    ids = docs.select("doc_id", F.unhex(F.sha2(F.col(text_col).cast("string"), 256)).alias("text_sha"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return ids.join(texts, "text_sha", "left").select("doc_id", *map(zero, numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
