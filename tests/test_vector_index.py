"""The inverted-file index: every row is in it, recall against the exact search, malformed vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval, vector_index


def _table(spark, x, extra=()):
    rows = [(i, "f", v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "chunk_id long, file string, embedding array<double>").repartition(5)


@pytest.mark.parametrize("kind", ["mixture", "random"])
def test_recall(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    if kind == "mixture":
        x = rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.3 * x
    bad = [(9001, "f", None), (9002, "f", [1.0]), (9003, "f", [float("nan")] * 16), (9004, "f", [0.0] * 16), (None, "f", x[0].tolist())]
    e = _table(spark, x, bad)
    model = vector_index.fit(e, sample=2000)
    index = vector_index.build(e, model, str(tmp_path / "i"), files=4)
    assert sorted(r["id"] for r in index.collect()) == list(range(4000))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 4000, 100)] + [(5000, [1.0, 2.0]), (5001, None)], "query_id long, vector array<double>")
    found, exact = vector_index.search(index, model, e, queries).cache(), retrieval.top_k(e, queries)
    share = {r["query_id"]: r["recall"] for r in vector_index.recall(exact, found).collect()}
    assert set(share) >= set(range(0, 4000, 100)) and np.mean([share[i] for i in range(0, 4000, 100)]) >= 0.9
    assert model.probes < len(model.centres) / (4 if kind == "mixture" else 1)
    # What is found has its exact distance, in order.
    want = {(r["query_id"], r["chunk_id"]): r["distance"] for r in exact.collect()}
    rows = found.collect()
    assert all(want.get((r["query_id"], r["chunk_id"]), r["distance"]) == r["distance"] for r in rows)
    for i in range(0, 4000, 100):
        own = sorted((r["pos"], r["distance"]) for r in rows if r["query_id"] == i)
        assert [p for p, _ in own] == list(range(1, 41)) and [d for _, d in own] == sorted(d for _, d in own)


def test_small_and_empty_tables(spark, tmp_path):
    e = _table(spark, np.eye(3))
    model = vector_index.fit(e)
    index = vector_index.build(e, model, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0])], "query_id long, vector array<double>")
    assert [r["chunk_id"] for r in vector_index.search(index, model, e, q).orderBy("pos").collect()] == [0, 1, 2]
    assert vector_index.search(index, model, e, q.limit(0)).count() == 0
    assert vector_index.fit(e.limit(0)) is None and vector_index.fit(e.select("chunk_id", F.array(F.lit(0.0)).alias("embedding"))) is None
    same = _table(spark, np.ones((50, 4)))
    m = vector_index.fit(same)
    i = vector_index.build(same, m, str(tmp_path / "j"))
    got = vector_index.search(i, m, same, spark.createDataFrame([(1, [2.0, 2.0, 2.0, 2.0])], q.schema)).collect()
    assert sorted(r["chunk_id"] for r in got) == list(range(40)) and {r["distance"] for r in got} == {0.0}
