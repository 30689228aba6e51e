"""The pipeline against plain Python, stage by stage, each on its own input."""

from __future__ import annotations

import pytest
from test_llm_operators import _groups, _norm, _set

import corpus_pipeline
from quarry.llm import pieces, quality_rules, weak_quality
from quarry.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    ws = Workspace(spark, "test")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(ws.stage(stage(spark, out[-1], SF), "step"))
    return [{r["doc_id"]: r for r in d.collect()} for d in out], out


def test_shape(spark, steps):
    rows, frames = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    for a, b in zip(rows, rows[1:]):
        assert set(b) <= set(a)
    for d in frames[:-1]:
        assert d.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}.keys() == rows[-1].keys()


def test_filters_take_effect(spark, steps):
    rows, frames = steps
    assert set(rows[1]) == {r["doc_id"] for r in quality_rules.judge(spark, frames[0]).filter("kept").collect()}
    assert set(rows[2]) == {r["doc_id"] for r in weak_quality.classify(spark, frames[1]).filter("kept").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in rows[1] if labels.get(i) == 1]
    assert sum(i in rows[2] for i in good) >= 0.97 * len(good)


def test_near_duplicates(steps):
    rows, _ = steps
    groups = _groups([(i, r["text"]) for i, r in rows[2].items()], corpus_pipeline.NEAR_PERCENT)
    assert set(rows[3]) == {i for i, (_, c) in groups.items() if i == c}


def test_near_duplicates_from_80_percent(spark):
    """Pairs on both sides of 80 percent, some below the 85 of op6."""
    rows, want = [], set()
    for i in range(60):
        w = [f"d{i}w{j}" for j in range(200)]
        for e in range(3 + i % 3):  # 0.86, 0.81 and 0.77
            w[20 + 30 * e] = "changed"
        rows += [(2 * i, " ".join(f"d{i}w{j}" for j in range(200)), "en", "s", 1), (2 * i + 1, " ".join(w), "en", "s", 1)]
        x, y = _set(rows[-2][1]), _set(rows[-1][1])
        want |= {2 * i} | ({2 * i + 1} if 100 * len(x & y) < 80 * len(x | y) else set())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 60 < len(want) < 120
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_decontamination(spark, steps):
    rows, _ = steps
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = _norm(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hits = lambda t: [(i, n) for w in [_norm(t)] for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
    for i, r in rows[3].items():
        found = hits(r["text"])
        covered = len({j for a, n in found for j in range(a, a + n)})
        assert (i in rows[4]) == (covered <= 0.5 * max(1, len(_norm(r["text"]))))
        if i in rows[4]:
            got = rows[4][i]
            assert not hits(got["text"]) and got["n_chars"] == len(got["text"])
            assert len(_norm(got["text"])) == len(_norm(r["text"])) - covered
            assert found or got == r


def test_encoding(steps):
    import sentencepiece

    rows, _ = steps
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert r["n_pieces"] == len(sp.encode(rows[4][i]["text"])) and r["round_trip"]


@pytest.mark.parametrize("k", range(5))
def test_empty_and_odd_tables(spark, k):
    from pyspark.sql import functions as F

    stage = corpus_pipeline.STAGES[k][1]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a few words here", "en", None, 3), (2, "", "", "", 0), (3, "x " * 20_000, "en", "s", 5), (3, "x " * 20_000, "en", "s", 5)], schema)
    out = stage(spark, odd.withColumn("kept", F.lit(1)).withColumn("spans", F.lit("x")), SF)
    assert out.count() <= 5 and (k == 4 or out.columns == corpus_pipeline.COLUMNS)


def test_each_row_by_its_own_verdict(spark):
    """Null ids, repeated rows, and different texts of one id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    source = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    good = [r["text"] for r in corpus_pipeline.rules(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(source)], schema), SF).collect()]
    rows = [(None, good[0], "en", "s", 1), (None, None, "en", "s", 2), (None, "junk " * 200, "en", "s", 3), (7, good[1], "en", "s", 4), (7, "too short", "en", "s", 5), (7, good[1], "en", "s", 6)]
    got = corpus_pipeline.rules(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted(r["n_chars"] for r in got) == [1, 4, 6]
    one, two, other = (" ".join(f"{a}{i}" for i in range(100)) for a in "xyz")
    rows = [(5, one, "en", "s", 1), (5, one, "en", "s", 2), (None, one, "en", "s", 3), (None, two, "en", "s", 4), (None, two, "en", "s", 5), (5, other, "en", "s", 6), (4, two + " more", "en", "s", 7), (None, None, "en", "s", 8), (None, "", "en", "s", 9)]
    got = sorted((r["n_chars"], r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema).coalesce(1), SF).collect())
    assert got == [(1, 5), (6, 5), (7, 4), (8, None), (9, None)]
