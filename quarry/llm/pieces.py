"""SentencePiece encoding and decoding by suffix-array matching.

The model is a byte-pair one (merges by rank) with byte fallback. Its pieces
hold a space mark at their beginning only, apart from pieces of spaces alone,
so a text falls into segments: one space mark, if any, and what follows it.

Encoding a batch:

1. The distinct segments of the batch are joined into one text, with a
   separator, and its suffix array, as deep as the longest piece, is built in numpy.
2. Every piece is looked up by binary search; the range it finds lists all its
   occurrences. These are the edges, sorted by where they end.
3. Edges are relaxed in order of position. A prefix of a segment has one
   encoding; an edge continues the encoding of the prefix before it if and only
   if the merges would leave its piece and that encoding's last piece side by
   side. So each position keeps the one edge that fits. Characters
   without a piece fall back to bytes.

Runs of several spaces: the last mark belongs to the next word's segment; if
that segment's first piece is the bare mark, it joins the run. The run's own
merges, which all have one score, go from left to right.

Decoding joins pieces and bytes and drops the first space. Encoded segments are
remembered within a worker, up to a bound. The tokenizer file's path is a
parameter.

Defined cases: a model of another kind than byte pairs is refused; a null text has null ids; an empty text has none; invalid byte
sequences in ids decode to U+FFFD; extra columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import arrow_text as at

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
MARK_BYTES = chr(MARK).encode()
#: Ends a segment in the batch's text; no character.
SEPARATOR = 0x110000
CACHE = 250_000
#: Segments that are indexed at a time.
BATCH = 15_000


class Model:
    """Pieces of a model file, and the order in which merges make them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = np.full(n, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_of[i] = int(self.text[i][3:5], 16)
                self.byte_id[self.byte_of[i]] = i
        plain = [i for i in range(n) if not special[i] and self.byte_of[i] < 0]
        self.id_of = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        if any(s != int(s) or s > 0 for t, s in self.score.items() if len(t) > 1):
            raise ValueError(f"{path}: the scores of its pieces are no merge order; only byte-pair models can be used")
        #: Rank in merge order; single characters, which no merge makes, come first.
        chars = [i for i in plain if len(self.text[i]) == 1]
        longer = sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        spaces = chr(MARK)
        longer = [i for i in longer if set(self.text[i]) != {spaces}]
        self.rank = np.full(n, -1, np.int64)
        self.rank[chars + longer] = np.arange(len(chars) + len(longer))
        self.of_rank = np.array(chars + longer, np.int32)
        ranks = {self.text[i]: r for r, i in enumerate(chars + longer)}
        self.n_chars = len(chars)
        #: How each piece is put together last: its merge of the best two parts.
        m = len(ranks)
        self.left, self.right = np.arange(m), np.arange(m)
        pair, made = [], []
        reach = np.ones(m, bool)
        for t, r in ranks.items():
            if len(t) == 1:
                continue
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pair.append(a * m + b)
                    made.append(r)
            got = self._merge(t, ranks, r)
            if got is None:
                reach[r] = False
            else:
                self.left[r], self.right[r] = got
        order = np.argsort(np.array(pair, np.int64))
        self.pair, self.made = np.array(pair, np.int64)[order], np.array(made, np.int64)[order]
        usable = [(t, r) for t, r in ranks.items() if reach[r]]
        self.use_rank = np.array([r for _, r in usable], np.int64)
        self.use_len = np.array([len(t) for t, _ in usable], np.int64)
        #: The suffix array's depth: characters of the longest piece.
        self.deep = int(self.use_len.max(initial=1))
        self.use_char = np.zeros((len(usable), self.deep), np.uint32)
        self.use_char[np.arange(self.deep)[None, :] < self.use_len[:, None]] = np.frombuffer("".join(t for t, _ in usable).encode("utf-32-le"), np.uint32)
        raw = [bytes([self.byte_of[i]]) if self.byte_of[i] >= 0 else b"" if special[i] else self.text[i].replace(spaces, " ").encode() for i in range(n)]
        self.raw_len = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._runs: dict[int, list[int]] = {}

    @staticmethod
    def _merge(t: str, ranks: dict[str, int], own: int) -> tuple[int, int] | None:
        """The last two parts when merges alone spell t; None if they end elsewhere."""
        parts = list(t)
        while len(parts) > 1:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] >= 1 << 60:
                return None
            i = best[1]
            if len(parts) == 2:
                a, b = ranks.get(parts[0]), ranks.get(parts[1])
                return (a, b) if a is not None and b is not None else None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return None

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of the two pieces' text leave exactly the two (by rank)."""
        m = len(self.left)
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 60, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            key = x * m + y
            at_ = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            clash = (self.pair[at_] == key) & (self.made[at_] < lim)
            # Take apart the piece made later; once it is a character, the other.
            first = x > y
            stuck_x, stuck_y = self.left[x] == x, self.left[y] == y
            take_x = first & ~stuck_x | stuck_y & ~stuck_x
            # Undoing the left piece leaves its right part next to b, and before its rank; undoing b leaves its left part.
            nx = np.where(take_x, self.right[x], x)
            ny = np.where(~take_x & ~stuck_y, self.left[y], y)
            nl = np.where(take_x, x, y + 1)
            ok[live[clash]] = False
            go = ~clash & ~(stuck_x & stuck_y)
            a[live], b[live], limit[live] = nx, ny, nl
            live = live[go]
        return ok

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of n space marks: equal scores merge from the left."""
        if n not in self._runs:
            mark = chr(MARK)
            size, nxt = [1] * n, list(range(1, n)) + [-1]
            prev = [-1, *range(n - 1)]
            heap = [i for i in range(n - 1)] if mark * 2 in self.id_of else []
            heapq.heapify(heap)
            while heap:
                i = heapq.heappop(heap)
                j = nxt[i] if size[i] else -1
                if j < 0 or mark * (size[i] + size[j]) not in self.id_of:
                    continue
                size[i], size[j], nxt[i] = size[i] + size[j], 0, nxt[j]
                if nxt[i] >= 0:
                    prev[nxt[i]] = i
                    heapq.heappush(heap, i)
                if prev[i] >= 0:
                    heapq.heappush(heap, prev[i])
            out, i = [], 0
            while i >= 0 and i < n:
                out.append(self.id_of.get(mark * size[i], -1))
                i = nxt[i]
            if -1 in out:  # a model without the mark itself
                out = [x for y in out for x in ([y] if y >= 0 else [int(self.byte_id[b]) for b in mark.encode()])]
            if len(self._runs) > 1000:
                self._runs.clear()
            self._runs[n] = out
        return self._runs[n]

    # -- the batch's index -------------------------------------------------

    def encode_segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, flat, and where each segment's begin (one more entry than segments)."""
        chars = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(s) for s in segs], np.int64)
        text = np.full(len(chars) + len(segs), SEPARATOR, np.uint32)
        text[np.arange(len(chars)) + np.repeat(np.arange(len(segs)), lens)] = chars
        alphabet, code = np.unique(text, return_inverse=True)
        code = code.astype(np.int64) + 1
        n = len(code)
        bits = max(1, int(len(alphabet) + 1).bit_length())
        per = 62 // bits
        words = -(-(self.deep + 1) // per)  # one letter more than the longest piece, to bound its range from above
        padded = np.concatenate([code, np.zeros(per * words, np.int64)])
        keys = []
        for w in range(words):
            k = np.zeros(n, np.int64)
            for j in range(per):
                k = (k << bits) | padded[w * per + j : w * per + j + n]
            keys.append(k)
        suffix = np.lexsort(keys[::-1]) if words > 1 else np.argsort(keys[0], kind="stable")
        keys = [k[suffix] for k in keys]
        inside = np.arange(self.deep)[None, :] < self.use_len[:, None]
        found = np.minimum(np.searchsorted(alphabet, self.use_char), len(alphabet) - 1)
        here = ((alphabet[found] == self.use_char) | ~inside).all(1)
        rank, size = self.use_rank[here], self.use_len[here]
        letters = np.zeros((len(rank), per * words), np.int64)
        letters[:, : self.deep] = np.where(inside[here], found[here] + 1, 0)
        top = np.arange(per * words)[None, :] >= size[:, None]
        lo = self._bound(keys, letters, per, bits)
        hi = self._bound(keys, np.where(top, (1 << bits) - 1, letters), per, bits)
        count = hi - lo
        total = int(count.sum())
        which = np.repeat(np.arange(len(count)), count)
        start = suffix[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(total)]
        end = start + size[which]
        return self._relax(text, start, end, rank[which], lens)

    @staticmethod
    def _bound(keys: list[np.ndarray], letters: np.ndarray, per: int, bits: int) -> np.ndarray:
        """For each row of codes, how many suffixes are smaller."""
        lo = np.zeros(len(letters), np.int64)
        hi = np.full(len(letters), len(keys[0]), np.int64)
        for w, key in enumerate(keys):
            want = np.zeros(len(letters), np.int64)
            for j in range(per):
                want = (want << bits) | letters[:, w * per + j]
            if w == 0:
                lo, hi = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
                continue
            # Within equal earlier words: bisect all rows at once, for both ends.
            new = []
            for side in ("left", "right"):
                a, b = lo.copy(), hi.copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    v = key[np.minimum(mid, len(key) - 1)]
                    up = (v < want if side == "left" else v <= want) & (a < b)
                    b = np.where((a < b) & ~up, mid, b)
                    a = np.where(up, mid + 1, a)
                new.append(a)
            lo, hi = new
        return lo

    def _relax(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        begin = np.cumsum(lens + 1) - (lens + 1)
        place = np.arange(n) - np.repeat(begin, lens + 1)  # place in the own segment
        whole = np.zeros(n, bool)  # characters that are pieces
        whole[start[end == start + 1]] = True
        bare = ~whole
        bare[begin + lens] = False
        # The piece that ends the encoding before each position: -1 a bare character or the segment's start, -2 not reached.
        last = np.full(n + 1, -2, np.int64)
        came = np.zeros(n + 1, np.int64)
        last[begin] = -1
        depth = place[end - 1] + 1
        order = np.argsort(depth, kind="stable")
        start, end, rank, depth = start[order], end[order], rank[order], depth[order]
        steps = int(lens.max()) if len(lens) else 0
        cuts = np.searchsorted(depth, np.arange(1, steps + 2))
        chars = np.flatnonzero(bare)
        by = np.argsort(place[chars], kind="stable")
        chars = chars[by]
        bare_cuts = np.searchsorted(place[chars], np.arange(0, steps + 1))
        for d in range(1, steps + 1):
            a, b = cuts[d - 1], cuts[d]
            s, r, e = start[a:b], rank[a:b], end[a:b]
            prev = last[s]
            fit = prev == -1
            ask = np.flatnonzero(prev >= 0)
            if len(ask):
                fit[ask] = self.beside(prev[ask], r[ask])
            last[e[fit]] = r[fit]
            came[e[fit]] = s[fit]
            c = chars[bare_cuts[d - 1] : bare_cuts[d]]
            if len(c):
                last[c + 1] = -1
                came[c + 1] = c
        # Walk back from every segment's end, all segments at once.
        cur = begin + lens
        seg = np.flatnonzero(lens > 0)
        ends, owner = [], []
        while len(seg):
            p = cur[seg]
            ends.append(p)
            owner.append(seg)
            cur[seg] = came[p]
            seg = seg[cur[seg] > begin[seg]]
        if not ends:
            return np.zeros(0, np.int32), np.zeros(len(lens) + 1, np.int64)
        ends, owner = np.concatenate(ends), np.concatenate(owner)
        order = np.argsort(ends, kind="stable")
        ends, owner = ends[order], owner[order]
        piece = last[ends]
        ids = np.where(piece >= 0, self.of_rank[np.maximum(piece, 0)], -1).astype(np.int32)
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            raw = [chr(int(text[p - 1])).encode("utf-8", "surrogatepass") for p in ends[lone]]
            times = np.ones(len(ids), np.int64)
            times[lone] = [len(x) for x in raw]
            out = np.repeat(ids, times)
            owner = np.repeat(owner, times)
            out[out < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids = out
        return ids, np.searchsorted(owner, np.arange(len(lens) + 1))


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes slices of texts; keeps the ids of segments it has met, by hash, up to a bound."""

    def __init__(self, m: Model):
        self.m = m
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, segs: list[str]) -> None:
        got = [self.m.encode_segments(segs[a : a + BATCH]) for a in range(0, len(segs), BATCH)]
        ids = np.concatenate([x for x, _ in got])
        sizes = np.concatenate([np.diff(x) for _, x in got])
        at_ = np.concatenate([[0], np.cumsum(sizes)])
        begin = np.concatenate([self.at, at_[:-1] + len(self.ids)])
        self.n = np.concatenate([self.n, np.diff(at_)])
        self.ids = np.concatenate([self.ids, ids])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every)
        self.keys, self.at, self.n = every[order], begin[order], self.n[order]

    def slice(self, t: at.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a slice's texts and where each text's begin."""
        if MARK_BYTES in (raw := t.data.tobytes()):  # a mark in the text stands for a space
            parts = [raw[a:b].replace(MARK_BYTES, b" ") for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())]
            t = at.Texts(t.first, t.last, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), t.valid)
        # Segments: each begins at a space or at a text's start; several spaces are a run and a segment.
        empty = np.diff(t.offsets) == 0
        is_space = t.data == 0x20
        head = is_space.copy()
        text_starts = t.offsets[:-1][~empty]
        head[text_starts] = True
        starts = np.flatnonzero(head)
        lens = np.diff(np.append(starts, len(t.data)))
        spaced = is_space[starts]
        # A text gets a space in front: its first segment has one mark by itself.
        first = np.zeros(len(starts), bool)
        first[np.searchsorted(starts, text_starts)] = True
        body_start, body_len = starts + spaced, lens - spaced
        # A text that begins with a space: the mark in front is a run of its own before that space's segment.
        text_of = np.repeat(np.arange(len(t)), np.diff(np.searchsorted(starts, t.offsets)))
        some = body_len > 0
        key = np.zeros(len(starts), np.uint64)
        key[some] = at.byte_hashes(t.data, body_start[some], body_len[some])
        uniq, where = np.unique(key[some], return_index=True)
        known = np.zeros(len(uniq), bool)
        if len(self.keys) > CACHE:
            self._reset()
        if len(self.keys):
            p = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
            known = self.keys[p] == uniq
        new = where[~known]
        if len(new):
            s, n = body_start[some][new], body_len[some][new]
            raw = t.data.tobytes()
            self._learn(uniq[~known], [chr(MARK) + raw[a : a + k].decode("utf-8", "surrogatepass") for a, k in zip(s.tolist(), n.tolist())])
        # Ids per segment: those of a body, or none where a mark stands alone (it belongs to a run).
        slot = np.searchsorted(self.keys, key[some])
        n_ids = np.zeros(len(starts), np.int64)
        src = np.zeros(len(starts), np.int64)
        n_ids[some], src[some] = self.n[slot], self.at[slot]
        marks = np.ones(len(starts), np.int64)
        marks[first & spaced] = 2
        simple = some & (marks == 1)
        prev_bare = np.zeros(len(starts), bool)
        prev_bare[1:] = ~some[:-1] & (text_of[1:] == text_of[:-1])
        if bool((simple & ~prev_bare).all()):
            return self._gather(n_ids, src, text_of, len(t))
        # Runs of marks: rare. Go through the segments that touch one.
        extra: dict[int, list[int]] = {}
        bare = self.m.id_of.get(chr(MARK), -1)
        run, run_text = 0, -1
        todo = np.flatnonzero(~some | (marks > 1) | prev_bare)
        for i in todo.tolist():
            if text_of[i] != run_text:
                run, run_text = 0, int(text_of[i])
            run += int(marks[i])
            ends_text = i + 1 == len(starts) or text_of[i + 1] != text_of[i]
            if some[i]:
                if self.ids[src[i]] == bare:
                    extra[i] = self.m.spaces(run)
                    src[i] += 1
                    n_ids[i] -= 1
                elif run > 1:
                    extra[i] = self.m.spaces(run - 1)
                run = 0
            elif ends_text:
                extra[i] = self.m.spaces(run)
                run = 0
        ids, at_ = self._gather(n_ids, src, np.arange(len(starts)), len(starts))
        before = np.zeros(len(starts), np.int64)
        for i, x in extra.items():
            before[i] = len(x)
        n_all = n_ids + before
        total = np.cumsum(n_all)
        out = np.empty(int(total[-1]), np.int32)
        keep = np.ones(len(out), bool)
        for i, x in extra.items():
            a = int(total[i] - n_all[i])
            out[a : a + len(x)] = x
            keep[a : a + len(x)] = False
        out[keep] = ids
        bounds = np.searchsorted(text_of, np.arange(len(t) + 1))
        return out, np.concatenate([[0], total])[bounds]

    def _gather(self, n: np.ndarray, src: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.cumsum(n)
        ids = self.ids[np.repeat(src - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        bounds = np.searchsorted(owner, np.arange(owners + 1))
        return ids, np.concatenate([[0], total])[bounds]


def decode_slice(m: Model, ids: np.ndarray, at_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of ids, flat, and where each text's begin; the first space of a text is dropped."""
    n = m.raw_len[ids]
    total = np.cumsum(n)
    raw = m.raw[np.repeat(m.raw_at[ids] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
    bounds = np.concatenate([[0], total])[at_]
    some = np.flatnonzero(np.diff(bounds) > 0)
    drop = bounds[some][raw[bounds[some]] == 0x20]
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    return raw[keep], bounds - np.searchsorted(drop, bounds)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(model(path))
    return _ENCODERS[path]


def _add_ids(path: str, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            for t in at.slices(batch.column(text_at)):
                ids, bounds = enc.slice(t)
                arr = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~t.valid))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(t.first, len(t)) for c in range(batch.num_columns)] + [arr], names=names)

    return run


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", path: str = MODEL) -> DataFrame:
    """The rows with their piece ids added, in place of a column of that name."""
    docs = docs.drop(ids_col)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids_col)).schema
    return docs.mapInArrow(_add_ids(path, docs.columns.index(text_col), [*docs.columns, ids_col]), schema)


def _add_text(path: str, ids_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(ids_at)
                flat = np.asarray(lists.flatten()).astype(np.int64)
                sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
                raw, bounds = decode_slice(m, flat, np.concatenate([[0], np.cumsum(sizes)]))
                data = raw.tobytes()
                texts = [data[x:y].decode("utf-8", "replace") if ok else None for x, y, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.asarray(lists.is_valid()).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(part.num_columns)] + [pa.array(texts, pa.string())], names=names)

    return run


def decode(rows: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """The rows with the text of their piece ids added, in place of a column of that name."""
    rows = rows.drop(text_col)
    schema = rows.select("*", F.lit(None).cast("string").alias(text_col)).schema
    return rows.mapInArrow(_add_text(path, rows.columns.index(ids_col), [*rows.columns, text_col]), schema)


def _add_both(path: str, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            for t in at.slices(batch.column(text_at)):
                ids, bounds = enc.slice(t)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~t.valid))
                raw, ends = decode_slice(enc.m, ids, bounds)
                data = raw.tobytes()
                texts = [data[x:y].decode("utf-8", "replace") if ok else None for x, y, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), t.valid.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(t.first, len(t)) for c in range(batch.num_columns)] + [lists, pa.array(texts, pa.string())], names=names)

    return run


def round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows, which meet one Python worker and not two."""
    docs = docs.drop(ids_col, decoded_col)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids_col), F.lit(None).cast("string").alias(decoded_col)).schema
    return docs.mapInArrow(_add_both(path, docs.columns.index(text_col), [*docs.columns, ids_col, decoded_col]), schema)


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, a digest of the ids, and whether decoding them gives the text back."""
    rows = round_trip(docs.select("doc_id", "text"), path=path)
    return rows.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("pieces_hash"),
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.col("decoded").eqNullSafe(F.translate("text", "▁", " ")).alias("round_trip"),
    ).withColumn("n_pieces", F.when(F.col("text_bytes").isNotNull(), F.col("n_pieces")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
