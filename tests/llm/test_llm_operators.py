"""The dealt operators on small fixtures: brute force, exact round trips, and the edge cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import arrow_text, decontaminate, html_text, language_id, masked_lm, minhash, pieces, quality_rules, sharding, warc, weak_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "und", "les", "que"]) if rng.random() < 0.4 else "".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus() -> list[tuple]:
    base = _words(120, 1)
    w = base.split()
    rows = [
        (1, base, "en"), (2, base, "en"), (3, base.upper(), None), (4, " ".join(w[:60] + ["changed"] + w[61:]), "de"), (5, " ".join(w[:40]) + _words(60, 2), "fr"),
        (6, None, None), (7, "", "en"), (8, "one", "en"), (9, "one two three", "en"), (10, " \n\t ", "es"), (11, _words(30_000, 3), "de"), (12, "日本語 テキスト " * 40, None),
        (13, "same line\n" * 60, "en"), (14, "A B C " * 30, "en"), (15, "1 2 3 %%% $$$ ", "fr"), (15, "1 2 3 %%% $$$ ", "fr"), (None, "no id here at all today", "en"), (16, "x" * 50_000, "en"),
    ]
    rows += [(100 + i, _words(80, 50 + i), ["en", "de", "fr", "es"][i % 4]) for i in range(40)]
    return [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns whose names the operators use themselves."""
    names = "kept score n_words n_hit items spans hits pll n_tokens digest sig cluster block key size slot law lang_pred piece_ids decoded weak_label quality_score chars common w n t html url page_id a b"
    return docs.select("*", *(F.lit("x").alias(c) for c in names.split()))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- word hashes ---------------------------------------------------------------


def test_words_of_slices():
    texts = ["a b", None, "", "  c\td\n", "ende", "x" * 9000 + " y"]
    for t in arrow_text.slices(pa.array(texts), limit=4):
        w = arrow_text.words(t, arrow_text.NOT_SPACE)
        for i in range(len(t)):
            got = [t.data[s : s + n].tobytes().decode() for s, n in zip(w.starts[w.first[i] : w.first[i + 1]], w.lens[w.first[i] : w.first[i + 1]])]
            assert got == (texts[t.first + i] or "").split()


# -- 1 -------------------------------------------------------------------------


def _pages(spark):
    big = "<p>" + "page " * 40 + "</p>"
    rows = [(3, "http://a/", big), (1, "http://b/", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "n", big), (1, "again", big), (8, "é\r\n", "ü" * 200_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    rows, pages = _pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark, pages.withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1)), path, warc.Workspace(spark, "t"))
    got = warc.read_records(spark, path).collect()
    assert len(got) == len(rows)
    by_uri = {r["target_uri"]: r for r in got if r["record_type"] == "response"}
    assert bytes(by_uri["http://b/"]["payload"]).decode() == rows[0][2]
    assert bytes(by_uri["é%0D%0A"]["payload"]).decode() == rows[-1][2]
    kinds = Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[("urn:page:3", "revisit", "urn:page:1")] == 1 and kinds[("urn:page:1", "response", None)] == 2 and kinds[("urn:page:null", "revisit", "urn:page:1")] == 1
    assert kinds[("urn:page:4", "response", None)] == kinds[("urn:page:5", "response", None)] == 1
    assert {r["payload_digest"] for r in got if r["record_id"] == "urn:page:6"} == {hashlib.sha256(b"").hexdigest()}
    only = warc.read_records(spark, path, payload=False).filter("record_type = 'revisit'")
    assert "record_type" in only._jdf.queryExecution().executedPlan().toString()
    assert {(r["payload"], r["payload_bytes"]) for r in only.collect()} == {(None, len(rows[0][2]))}


def test_warc_foreign_and_uncommitted(spark, tmp_path):
    import gzip

    rec = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhell{i}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec(1)) + gzip.compress(rec(2)))
    (tmp_path / "b.warc").write_bytes(rec(3) + rec(4))
    got = warc.read_records(spark, f"file://{tmp_path}").filter("record_id in ('urn:x:2', 'urn:x:3')").collect()
    assert sorted(bytes(r["payload"]) for r in got) == [b"hell2", b"hell3"]
    # A part that no manifest lists is no part of an archive that has manifests.
    w = warc.WarcWriter({"path": str(tmp_path / "m")})
    row = dict(record_type="response", record_id="r", target_uri="u", date="d", refers_to=None, payload_digest="x", payload_bytes=2, content_type="t", payload=b"hi")
    kept, lost = w.write(iter([pa.RecordBatch.from_pylist([row])])), w.write(iter([pa.RecordBatch.from_pylist([row])]))
    assert kept.name != lost.name
    w.commit([kept])
    assert warc.read_records(spark, str(tmp_path / "m")).count() == 1


def test_warc_of_no_pages(spark):
    got = warc.op1_warc
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = None
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-warc-")
    empty.write.mode("overwrite").parquet(f"{path}/pages.parquet")
    assert got(spark, path).count() == 0


def test_warc_reads_ahead(tmp_path):
    """Few reads for records in a row, little for leaps over large payloads."""
    data = np.random.default_rng(1).integers(0, 256, 3_000_000, dtype=np.uint8).tobytes()

    class Counted:
        def __init__(self):
            self.at, self.reads, self.bytes = 0, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.reads, out = self.reads + 1, data[self.at : self.at + n]
            self.bytes += len(out)
            return out

    f = Counted()
    scan = warc._Scan(f, len(data))
    assert all(scan._at(a, warc.HEAD) == data[a : a + warc.HEAD] for a in range(0, len(data), 1000))
    assert f.reads < 20
    f = Counted()
    scan = warc._Scan(f, len(data))
    assert all(scan._at(a, 100) == data[a : a + 100] for a in range(0, len(data), 500_000))
    assert f.bytes < 10 * warc.HEAD


# -- 2 -------------------------------------------------------------------------


def test_sharding(spark, clash, empty):
    def run(d):
        size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
        r = d.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32")).withColumn("vslot", sharding.virtual_slot("doc_id", "text_crc32"))
        m = sharding.new_map(sharding.slot_sums(r), 5)
        return r, m, sharding.place(r, m).collect()

    r, m, got = run(clash)
    assert len(got) == len(corpus())
    assert {(x["doc_id"], x["text_crc32"]) for x in got} == {(i, zlib.crc32((t or "").encode())) for i, t, *_ in corpus()}
    for s in range(5):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    # The same greedy rule by hand.
    sums = sorted(((x["bytes"], x["vslot"]) for x in sharding.slot_sums(r).collect()), reverse=True)
    load, want = [0] * 5, {}
    for b, v in sums:
        k = load.index(min(load))
        load[k] += b
        want[v] = k
    assert {x["vslot"]: x["shard"] for x in m.collect()} == want
    nxt = sharding.rebalance(m, sharding.slot_sums(r), 6).collect()
    assert {x["version"] for x in nxt} == {2} and len(nxt) == len(want) and {x["shard"] for x in nxt} <= set(range(6))
    assert run(empty)[2] == []


def test_sharding_of_heavy_ids(spark, tmp_path):
    """A doc_id that is repeated very often, with one text or several, fills no shard."""
    rows = [(7, "same text", "en", "s", 9)] * 1000 + [(8, f"text {i % 50:04d}", "en", "s", 9) for i in range(1000)] + [(100 + i, "other txt", "en", "s", 9) for i in range(400)] + [(None, "same text", "en", "s", 9)] * 500
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op2_virtual_slots(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) < 1.05 * min(load.values())
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_sharding_versions(spark, docs, tmp_path):
    r = docs.select("doc_id", F.lit(10).cast("long").alias("size"), F.lit(1).alias("text_crc32")).withColumn("vslot", sharding.virtual_slot("doc_id", "text_crc32"))
    m = sharding.new_map(sharding.slot_sums(r), 4)
    sharding.save_map(m, str(tmp_path / "map"))
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, str(tmp_path / "map")), sharding.slot_sums(r), 5), str(tmp_path / "map"))
    assert {x["version"] for x in sharding.load_map(spark, str(tmp_path / "map")).collect()} == {2}
    old = {x["vslot"]: x["shard"] for x in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {x["vslot"]: x["shard"] for x in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    assert sum(old[v] == new[v] for v in old) >= len(old) / 2  # most slots stay


# -- 3 -------------------------------------------------------------------------


def test_quality_rules(spark, clash, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(spark, clash).collect()}
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        inside = {j for i_ in range(len(w) - 2) if c[tuple(w[i_ : i_ + 3])] > 1 for j in range(i_, i_ + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[(i, len(w))]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(spark, empty).count() == 0


def test_divergence_against_numpy(spark, docs):
    ws = warc.Workspace(spark, "t")
    feats = ws.stage(quality_rules.features(docs), "features")
    table = ws.stage(quality_rules.references(feats), "references")
    refs = {r["lang"]: r for r in table.collect()}
    for r in quality_rules.distances(feats, table).filter("doc_id >= 100 or doc_id = 11").collect():
        ref = refs[r["lang"]] if r["lang"] in refs and refs[r["lang"]]["ref_words"] >= quality_rules.MIN_REFERENCE else refs["*"]

        def js(p, q):
            m = (p + q) / 2
            k = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
            return np.sqrt(max(0, (k(p) + k(q)) / 2))

        p = np.array(r["chars"]) / sum(r["chars"])
        assert r["char_distance"] == pytest.approx(js(p, np.array(ref["char_p"])), abs=1e-6)
        v = np.zeros(len(quality_rules.VOCABULARY) + 1)
        for x in r["common"]:
            v[x["code"] - 1] = x["n"] / r["n_words"]
        v[-1] = 1 - v.sum()
        q = np.array([*ref["word_p"], 1 - sum(ref["word_p"])])
        assert r["word_distance"] == pytest.approx(js(v, q), abs=1e-6)


# -- 4 -------------------------------------------------------------------------


def test_masked_gradient():
    net = masked_lm.Network()
    net.p = [x.astype(np.float64) for x in net.p]
    rng = np.random.default_rng(0)
    c, y = rng.integers(0, masked_lm.CLASSES + 1, (4, 40)), rng.integers(0, masked_lm.CLASSES, 40)
    _, g = net.gradient(c, y)
    for k, x in enumerate(net.p):
        at = tuple(rng.integers(0, s) for s in x.shape)
        old = x[at]
        x[at] = old + 1e-5
        up, _ = net.gradient(c, y)
        x[at] = old - 1e-5
        down, _ = net.gradient(c, y)
        x[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_masked_lm(spark, clash, docs, empty):
    vocab, flat = masked_lm.fit(spark, docs)
    assert vocab.log_share.max() <= 0 and np.isfinite(flat).all()
    got = masked_lm.score(spark, clash, (vocab, flat)).collect()
    assert [r["n_tokens"] for r in got] == [len((t or "").split()) for _, t, *_ in corpus()]
    # One text by hand: every position masked in turn.
    text = corpus()[0][1].lower().split()
    h = [int(arrow_text.byte_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] % np.uint64(masked_lm.BUCKETS)) for w in text]
    net, total = masked_lm.Network().load(flat), 0.0
    for i, b in enumerate(h):
        window = [vocab.klass[h[j]] if 0 <= j < len(h) else masked_lm.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
        total += net.log_softmax(np.array(window)[:, None])[1][0, vocab.klass[b]] + vocab.log_share[b]
    assert got[0]["pll"] == pytest.approx(total, rel=1e-4)
    assert {(r["pll"], r["mean_pll"]) for r in got if not r["n_tokens"]} == {(0.0, None)}
    assert masked_lm.score(spark, empty, masked_lm.fit(spark, empty)).count() == 0


def test_masked_lm_tells_all_words_apart(spark):
    """More words than 16 bits hold: each has its own count, and the classes grow with them."""
    n = 90_000
    rows = [(i, " ".join(f"w{j}" for j in range(i * 300, i * 300 + 300)), "en", "s", 0) for i in range(n // 300)] + [(1000, "common " * 5_000, "en", "s", 0)]
    vocab, flat = masked_lm.fit(spark, spark.createDataFrame(rows, DOCS), rounds=1)
    assert vocab.table.count() == n + 1 and vocab.table.filter("n = 1").count() == n
    assert vocab.classes == 2 * masked_lm.CLASSES and len(flat) == masked_lm.Network(classes=vocab.classes).flat().size
    k = vocab.table.limit(2000).toPandas()
    klass = vocab.bands.klass(k["word"].to_numpy(), k["n"].to_numpy())
    assert klass.max() >= masked_lm.CLASSES


def test_masked_lm_ignores_layout(spark):
    """Fitted on 2 and on 7 partitions, documents have the same scores; and training beats the words' shares alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).cache()
    scores = []
    for parts in (2, 7):
        model = masked_lm.fit(spark, d.repartition(parts))
        scores.append({r["doc_id"]: r["pll"] for r in masked_lm.score(spark, d, model).collect()})
    assert all(b == pytest.approx(scores[1][i], rel=1e-3) for i, b in scores[0].items())
    bare = masked_lm.Network(classes=model[0].classes)
    mass = model[0].bands.mass.reshape(bare.groups, -1) + 1.0
    bare.p = [0 * x for x in bare.p]
    bare.p[2 * masked_lm.WINDOW + 1] = np.log(mass / mass.sum(1, keepdims=True)).ravel().astype(np.float32)
    alone = sum(r["pll"] for r in masked_lm.score(spark, d, (model[0], bare.flat())).collect())
    assert sum(scores[1].values()) > 0.99 * alone


def test_masked_hierarchy():
    """The ways to the classes have the probabilities of the whole distribution, and the gradient is theirs."""
    net = masked_lm.Network(classes=3 * masked_lm.CLASSES)
    net.p = [x.astype(np.float64) for x in net.p]
    rng = np.random.default_rng(1)
    c, y = rng.integers(0, net.classes + 1, (4, 50)), rng.integers(0, net.classes, 50)
    _, s = net.log_softmax(c)
    assert np.allclose(np.exp(s).sum(1), 1) and np.allclose(net.log_prob(c, y), s[np.arange(50), y])
    _, g = net.gradient(c, y)
    for k, x in enumerate(net.p):
        at = np.unravel_index(np.abs(g[k]).argmax(), x.shape)
        old = x[at]
        x[at] = old + 1e-5
        up, _ = net.gradient(c, y)
        x[at] = old - 1e-5
        down, _ = net.gradient(c, y)
        x[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# -- 5 -------------------------------------------------------------------------


def test_pieces_against_library(spark, clash, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    odd = ["".join(rng.choice(["a", "the", "ing", " ", "  ", "    ", "\n", "日", "é", "X", "1", "!", "//", " of", "▁", "\0", "ü", "  int"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    odd += ["", " ", " " * 100, "x" * 3000, "▁", "▁▁a", " " * 37 + "q", "tail   "]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in pieces.decode(pieces.encode(d)).collect():
        assert r["piece_ids"] == sp.encode(r["text"])
        assert r["decoded"] == r["text"].replace("▁", " ") == sp.decode(r["piece_ids"]).replace("▁", " ")
    got = {(r["doc_id"], r["text"]): r for r in pieces.decode(pieces.encode(clash)).collect()}
    assert {(r["doc_id"], r["text"]): (r["piece_ids"], r["decoded"]) for r in pieces.round_trip(clash).collect()} == {k: (r["piece_ids"], r["decoded"]) for k, r in got.items()}
    for i, t, *_ in corpus():
        assert got[(i, t)]["piece_ids"] == (None if t is None else sp.encode(t)) and got[(i, t)]["decoded"] == t
    assert pieces.digest(empty).count() == 0


# -- 6 -------------------------------------------------------------------------


class _Toy:
    """A model file as the library would read it: characters, and merges up to a piece of forty letters."""

    pieces = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), "\u2581", "a", "b", *("ab" * (1 << k) for k in range(5)), "ab" * 20]

    def __init__(self, model_file):
        self.fraction = 0.5 if "unigram" in model_file else 0.0

    def vocab_size(self):
        return len(self.pieces)

    def id_to_piece(self, i):
        return self.pieces[i]

    def get_score(self, i):
        return -float(i) - self.fraction

    def is_unknown(self, i):
        return i == 0

    def is_control(self, i):
        return False

    is_unused = is_control

    def is_byte(self, i):
        return 1 <= i <= 256


def test_pieces_of_any_length(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", _Toy)
    model = pieces.Model("toy")
    assert model.deep >= 40
    ids, cuts = model.encode_segments(["ab" * 20, "ab" * 16, "ab" * 3])
    got = [[_Toy.pieces[i] for i in ids[a:b]] for a, b in zip(cuts, cuts[1:])]
    assert got == [["ab" * 20], ["ab" * 16], ["abab", "ab"]]
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.Model("unigram")


def _set(t):
    w = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _groups(rows, percent=85):
    ids = [i for i, *_ in rows]
    sets = [_set(t) for _, t, *_ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def test_near_duplicates_brute_force(spark, clash, empty):
    rows = [r for r in corpus() if r[0] is not None]
    got = minhash.near_duplicates(spark, clash).collect()
    assert len(got) == len(corpus())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == _groups(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    """Edited copies at all distances around the limit, over many blocks."""
    rng = random.Random(8)
    base = _words(150, 9).split()
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _groups(rows)


def _classes(rows):
    """(doc_id, set size, class, kept) of every row with an id; all rows of an id are one document."""
    sets: dict = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(_set(t))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(_set(t)), root(i), root(i) == i) for i, t in rows if i is not None)


@pytest.mark.parametrize("block", [8, 192])
def test_near_duplicates_of_repeated_ids_and_chains(spark, monkeypatch, block):
    """One id on several texts, groups of near copies around one text, and chains whose ends are far apart."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(500)}"
    texts = []
    for n, size in [(12, 60)] * 6 + [(30, 80)] * 6:
        base = [word() for _ in range(size)]
        for _ in range(n):
            texts.append(" ".join(base))
            base[rng.randrange(size)] = word()
    middle = [word() for _ in range(200)]
    for _ in range(300):
        t = list(middle)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(200)] = word()
        texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = [(2, "a b c d e f"), (5, "a b c d e f"), (5, "x y z q r s"), (9, "x y z q r s"), (11, None), (11, "x y z q r s"), (None, "a b c d e f"), (None, "alone"), (13, None), (13, "")]
    rows += [(rng.randrange(20, 2000), t) for t in texts]
    got = [tuple(r) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(r for r in got if r[0] is not None) == _classes(rows)
    assert sorted((r for r in got if r[0] is None), key=str) == [(None, 1, None, True), (None, 2, 2, False)]


def test_index_guarantee():
    """Any two signatures within the distance share a key."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for r in b:
        at = rng.choice(minhash.SYMBOLS, minhash.MAX_DISTANCE, replace=False)
        r[at] ^= np.uint16(1)
    x, y = minhash.index_keys(a), minhash.index_keys(b)
    assert x.shape[1] == minhash.SYMBOLS and (x == y).any(1).all()


# -- 7 -------------------------------------------------------------------------


def test_html(spark):
    main = "".join(f"<p>Sentence number {i}, with &amp; some words.  It goes\n on &lt;here&gt;.</p>" for i in range(6))
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies, you know.</p></div><div class="ad">Buy it.</div><article><h1>Title &eacute;</h1>{main}<!-- c --><p>open <b>bold<br>next</article>
    <aside><p>Side</p></aside><section class="comments"><p>Nice post, thanks for that!</p></section><form><input name=q></form><footer>&copy; x</footer></body></html>"""
    want = "\n".join(["Title é", *(f"Sentence number {i}, with & some words. It goes on <here>." for i in range(6)), "open bold next"])
    train = [page.replace("Sentence", w) for w in ("Sentence", "Another", "Third", "More")]
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page), (5, "u", "<p>unclosed <div"), (6, "u", "<div>" * 3000 + "deep"), (None, None, page.replace("number", "x" * 9000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5)).withColumn("odds", F.lit(5))
    model = html_text.train(train * 10)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark, pages, model).collect()}
    assert got[1] == got[4] == want and got[2] == got[3] == ""
    assert len(got) == 7
    assert html_text.extract(spark, pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>t</title><meta charset=utf-8><body>",
        "<head><title>t</title><link rel=x>",
        "<head><noscript><p>off</p></noscript><template><div>off</div></template>",
        "<head><noscript><link rel=x><body>",
        "<head><script>for(;i<n;){/* don't */}</script></head><body>",
        "<head><style>a:after{content:'</head><p>off'}</style></head><body>",
        "<body><script>for(;i<n;){/* don't */}</script>",
        "<body><svg><style>a<b{/* don't */}</style></svg>",
    ],
)
def test_html_open_heads_and_raw_content(spark, head):
    page = f"<html>{head}<article><h1>Title</h1><p>It's the first one.</p><p>And the second.</p></article></html>"
    nodes = html_text.parse(page)
    assert html_text.text(nodes, [True] * len(nodes)) == "Title\nIt's the first one.\nAnd the second."


def test_html_text_ends_a_head():
    for page in ("<head><title>t</title>plain <b>words</b>", "<head><title>t</title>plain words", "<head><meta><a href=x>plain</a> words"):
        nodes = html_text.parse(page)
        assert html_text.text(nodes, [True] * len(nodes)) == "plain words"


def test_html_without_a_model(spark):
    pages = spark.createDataFrame([(1, "<nav><p>Home</p></nav><div><p>Main words.</p><p>More.</p></div><div class=cookie><p>Yes</p></div>")], "page_id long, html string")
    assert html_text.extract(spark, pages, None).first()["text"] == "Main words.\nMore."


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000 + 'href="x', '<a "' * 250_000, '<c x="' * 160_000, "<div>" * 60_000 + "<li>" * 60_000, "<li><ul>" + "<div>" * 40_000 + "<li></li>" * 40_000, "<svg>" * 100_000 + "</div>" * 100_000, "<script></script " * 60_000, "</" * 400_000],
    ids=range(8),
)
def test_html_takes_linear_time(page):
    began = time.perf_counter()
    html_text.parse(page)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><article><p>Long text here</article>", "Long text here"),
        ("<html><head><title>t</title><article><p>Long text here", "Long text here"),
        ('<p>before<svg><path d="x"><p>after</p>', "before\nafter"),
        ("<div><svg><text>no</div><p>after</p>", "after"),
        ("<div><button>no</div><p>after", "after"),
        ("<select><option>no<p>after", "after"),
        ("""<head><script>for(;i<n;){/* don't */}"</head>"</script></head><p>x""", "x"),
        ("<head><noscript>no</noscript><p>x", "x"),
        ('<p title="a>b">x</p>', "x"),
        ('<p title="a>x</p><p>y', "x\ny"),
        ("3 < 4 and <5 </3 x", "3 < 4 and <5 </3 x"),
        ("<svg><foreignObject><p>no</p></foreignObject></svg><p>y", "y"),
        ("<template><p>no</template><p>y", "y"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>d", "a\nb\nc\nd"),
        ("a<!-- > b --><![CDATA[c]]><!x>d<!--", "acd"),
    ],
)
def test_html_mended(page, want):
    nodes = html_text.parse(page)
    assert html_text.text(nodes, [True] * len(nodes)) == want


def _article(page):
    """What the article element of a given page says, block by block."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S)
    inner = re.sub(r"</?(p|h\d|ul|li|div|blockquote)\b[^>]*>", "\n", inner.replace("<br>", " "))
    lines = html.unescape(re.sub(r"<[^>]+>", "", inner)).split("\n")
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def test_html_of_held_pages(spark):
    """Pages that training didn't see, as they are and with nothing but divisions to tell the parts by."""
    rows = sorted(r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html like '%<article>%'").collect())
    model = html_text.train(rows[:100])
    bare = lambda p: re.sub(r"<(/?)(article|nav|header|footer|aside|section|main)\b[^>]*>", r"<\1div>", re.sub(r' (class|id|role)="[^"]*"', "", p))
    for change, least in ((lambda p: p, 0.99), (bare, 0.95)):
        right = 0
        for page in rows[100:]:
            nodes = html_text.parse(change(page))
            right += html_text.extract_one(nodes, model.predict(html_text.features(nodes))) == _article(page)
        assert right >= least * len(rows[100:])


def test_html_fit_ignores_layout(spark):
    """The same trees, however the pages lie; copies and long pages don't matter."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html")
    a, b = (html_text.fit(p, train_pages=40) for p in (pages.repartition(2), pages.union(pages).repartition(7)))
    assert all(np.array_equal(x, y) for x, y in zip(a.leaf, b.leaf))


def test_html_hierarchy():
    nodes = html_text.parse("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    for seed in range(50):
        odds = np.random.default_rng(seed).normal(0, 3, len(nodes))
        kept = html_text.decode(nodes, odds)
        at = {id(n): k for n, k in zip(nodes, kept)}
        assert all(not k or n.up is None or n.up.up is None or at[id(n.up)] for n, k in zip(nodes, kept))


# -- 8 -------------------------------------------------------------------------


def _mixed():
    good = [(i, _words(90, i) + ". And so it is, the end.", "en", "s", 0) for i in range(120)]
    junk = [(500 + i, " ".join(f"x{i}{j}### |" if j % 2 else "ZZZ!! $$$" for j in range(60)), "en", "s", 0) for i in range(30)]
    return good, junk


def test_weak_quality(spark, clash, empty):
    good, junk = _mixed()
    rows = [*good, *junk, (900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n ", "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in weak_quality.classify(spark, d).collect()}
    assert all(got[i]["kept"] for i, *_ in good) and not any(got[i]["kept"] for i, *_ in junk)
    assert {(got[i]["quality_score"], got[i]["kept"]) for i in (900, 901, 902)} == {(0.0, False)}
    assert weak_quality.classify(spark, clash).count() == len(corpus())
    assert weak_quality.classify(spark, empty).count() == 0


def _plain_votes(text):
    """The ten labellers in plain Python: 2 good, 0 bad, 1 abstains."""
    common = {w for words in quality_rules.COMMON_WORDS.values() for w in words.split()}
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words]
    n = len(words)
    share = lambda hits: sum(hits) / n if n else 0.0
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    upper = sum(65 <= b <= 90 for b in raw) / max(1, sum(map(letter, raw)))
    values = [
        (share([any(b in b"#*$%&|<>" for b in w) for w in words]), lambda x: x > 0.15, lambda x: x < 0.03),
        (share([not any(map(letter, w)) for w in words]), lambda x: x > 0.2, lambda x: x < 0.06),
        (upper, lambda x: x > 0.4, lambda x: x < 0.15),
        (share([w.decode("utf-8", "replace") in common for w in low]), lambda x: x < 0.08, lambda x: x > 0.2),
        (share([len(w) for w in words]), lambda x: x > 10 or x < 2.2, lambda x: 3 < x < 8.5),
        (share([w[-1:] in (b".", b",") for w in words]), lambda x: x < 0.02, lambda x: x > 0.05),
        (share([w[-1:] in (b"!", b"?") for w in words]), lambda x: x > 0.25, lambda x: x < 0.02),
        (share([i > 0 and low[i] == low[i - 1] for i in range(n)]), lambda x: x > 0.2, lambda x: x < 0.03),
        (len(set(low)) / n**0.85 if n else 0.0, lambda x: x < 0.4, lambda x: x > 0.9),
    ]
    out = [0 if bad(x) else 2 if good(x) else 1 for x, bad, good in values] + [0 if n == 0 else 2 if n > 60 else 1]
    if 0 < n < weak_quality.MIN_WORDS:
        out = [1 if v == 0 and k in (3, 4, 5, 7, 8, 9) else v for k, v in enumerate(out)]
    return out


def test_weak_quality_against_plain_python(spark):
    """Votes, posteriors and scores of given documents, recomputed one by one."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120)
    label, weights = weak_quality.fit(d)
    got = {r["doc_id"]: r for r in weak_quality.classify(spark, d).collect()}
    for r in d.collect():
        v = _plain_votes(r["text"])
        odds = np.log(label.prior / (1 - label.prior)) + sum(np.log(label.given[0][k, x]) - np.log(label.given[1][k, x]) for k, x in enumerate(v))
        post = 1 / (1 + np.exp(-odds)) if (r["text"] or "").split() else 0.0
        assert got[r["doc_id"]]["weak_label"] == pytest.approx(post, abs=1e-9)
        t = next(arrow_text.slices(pa.array([r["text"]])))
        x = weak_quality.hashed(weak_quality.Doc(t))
        if weights is not None and len(x):
            score = 1 / (1 + np.exp(-(sum(float(weights[f]) for row in x.tolist() for f in row) / len(x) + float(weights[-1]))))
            assert got[r["doc_id"]]["linear_score"] == pytest.approx(score, abs=1e-4)
            assert got[r["doc_id"]]["quality_score"] == pytest.approx((score + post) / 2, abs=1e-4)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.7
    acc = np.linspace(0.65, 0.95, weak_quality.LABELLERS)
    right = rng.random((len(y), len(acc))) < acc
    v = np.where(right == y[:, None], weak_quality.GOOD, weak_quality.BAD)
    code, n = np.unique(v @ weak_quality._PLACE, return_counts=True)
    m = weak_quality.LabelModel(code, n)
    assert np.abs(m.accuracy - acc).max() < 0.03 and abs(m.prior - 0.7) < 0.03


# -- 9 -------------------------------------------------------------------------


def test_gru_gradient():
    net = language_id.Network(3, embed=4, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, n = rng.integers(97, 100, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5), np.array([6, 4, 6, 1, 6])
    _, g = net.gradient(x, y, n)
    for k, v in net.p.items():
        at = (98, 1) if k == "E" else tuple(rng.integers(0, s) for s in v.shape)
        old = v[at]
        v[at] = old + 1e-3
        up, _ = net.gradient(x, y, n)
        v[at] = old - 1e-3
        down, _ = net.gradient(x, y, n)
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=1e-4)


def _one_by_one(net, raw):
    """The sum of a text's position probabilities by a plain recurrence over each window."""
    p, H = net.p, net.h
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(data, d):
        h, out = np.zeros(H), []
        for byte in data:
            g = p["E"][byte] @ p[f"W{d}"] + p[f"c{d}"]
            zr = sig(g[: 2 * H] + h @ p[f"U{d}"])
            c = np.tanh(g[2 * H :] + (zr[H:] * h) @ p[f"V{d}"])
            h = zr[:H] * h + (1 - zr[:H]) * c
            out.append(h)
        return out

    n, total = len(raw), np.zeros(net.k)
    cores = [(0, n)] if n <= language_id.WHOLE else [(a, min(n, a + language_id.CORE)) for a in range(0, n, language_id.CORE)]
    for a, b in cores:
        lo, hi = (max(0, a - language_id.CONTEXT), min(n, b + language_id.CONTEXT)) if len(cores) > 1 else (0, n)
        f, back = states(raw[lo:hi], "f"), states(raw[lo:hi][::-1], "b")[::-1]
        for i in range(a - lo, b - lo):
            e = np.exp(np.concatenate([f[i], back[i]]) @ p["O"] + p["b"])
            total += e / e.sum()
    return total


def test_language_positions_one_by_one():
    """Every position of every text counts once, and as a plain recurrence would have it."""
    net = language_id.Network(3, seed=2)
    texts = ["a", "héllo wörld " * 3, "", None, "x" * language_id.WHOLE, "some words and more " * 60, "é" * 700]
    for batch in (2, 1024):
        language_id.BATCH, kept = batch, language_id.BATCH
        t = next(arrow_text.slices(pa.array(texts)))
        got = language_id.read(net, t)
        language_id.BATCH = kept
        for row, x in zip(got, texts):
            raw = (x or "").encode()
            assert row == pytest.approx(_one_by_one(net, raw), abs=1e-2)
            assert row.sum() == pytest.approx(len(raw), rel=1e-4)


def test_language_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = language_id.identify(spark, d, language_id.fit(d)).filter(language_id.held_out("doc_id") & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) > 50


def test_language_id(spark, empty):
    alpha = {"aa": "abc", "bb": "xyz"}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice(alpha[lang]) for _ in range(5)) for _ in range(30)), lang, "s", 0) for i in range(200) for lang in [["aa", "bb"][i % 2]]]
    rows += [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "12 34 !!", None, "s", 0), (None, "abcab cabca", None, None, None), (1003, "a" * 20_000, "aa", "s", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    model = language_id.fit(d)
    assert model[0] == ["aa", "bb"]
    got = {r["doc_id"]: r for r in language_id.identify(spark, d.select("doc_id", "text", "score"), model).withColumn("held", language_id.held_out("doc_id")).collect()}
    for i, _, lang, *_ in rows[:200]:
        assert got[i]["held"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert {(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)} == {("und", 0.0)}
    assert got[None]["lang_pred"] == "aa" and got[1003]["lang_pred"] == "aa"
    assert language_id.identify(spark, empty, language_id.fit(empty)).count() == 0


# -- 10 ------------------------------------------------------------------------


def _bench(spark):
    long = _words(25, 77)
    rows = [(1, long), (10, long.upper()), (2, "only three words"), (3, None), (4, "!!!"), (None, "no item id at all in this one here now ok"), (5, _words(12, 78)), (2, "only three words")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _norm(t):
    return BENCH_WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_decontamination_brute_force(spark, docs, clash, empty, block_words):
    items, bench = _bench(spark)
    long = items[0][1].split()
    planted = [(201, "before " + " ".join(long) + " after it"), (202, " ".join(long[3:14]) + " " + " ".join(long[3:14])), (203, "ONLY, three; words! only three words"), (204, " ".join(long[:9])), (205, items[6][1] + " only three")]
    d = clash.select(docs.columns).unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted], DOCS)).withColumn("spans", F.lit(3)).withColumn("n_hit", F.lit(3))
    got = {(r["doc_id"], r["text"]): r for r in decontaminate.match(spark, d, bench, block_words=block_words).collect()}
    for i, t in [*((i, t) for i, t, *_ in corpus()), *planted]:
        w, hit, names = _norm(t), set(), set()
        for item, text in items:
            s = _norm(text)
            if item is None or not s:
                continue
            k = min(10, len(s))
            for j in range(len(s) - k + 1):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == s[j : j + k]:
                        hit |= set(range(p, p + k))
                        names.add(str(item))
        r = got[(i, t)]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(names))
    clean = {r["doc_id"]: r["text"] for r in decontaminate.clean(decontaminate.match(spark, d, bench), max_coverage=1.0).collect()}
    assert clean[201] == "before  after it" and clean[204] == planted[3][1]
    assert 203 not in {r["doc_id"] for r in decontaminate.clean(decontaminate.match(spark, d, bench)).collect()}
    assert decontaminate.match(spark, empty, bench).count() == 0
    assert decontaminate.match(spark, docs, bench.limit(0)).filter("n_hit > 0").count() == 0
