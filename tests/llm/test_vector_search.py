"""Vector search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksieve.llm import vector_search as vs

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, neighbours=20):
    """{query id: [(vec_id, score)]}, nearest first."""
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    wide = max(len(v) for _, v in rows)
    x = np.array([v + [0.0] * (wide - len(v)) for _, v in rows])
    out = {}
    for i, v in rows:
        if i is not None and i % 20 == 0:
            score = vs._exact(np.array([v + [0.0] * (wide - len(v))] * len(x)), x)
            out[i] = sorted(((j, s) for (j, _), s in zip(rows, score.tolist()) if j != i), key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:neighbours]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert got.keys() == want.keys()
    assert all(len(got[q]) == len(want[q]) and len(set(got[q])) == len(got[q]) for q in want)
    return sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("spread", [0.3, None])
def test_recall_and_scores(spark, spread, monkeypatch):
    monkeypatch.setattr(vs, "BUCKET", 64)
    monkeypatch.setattr(vs, "ROWS", 200)  # buckets of several shards
    monkeypatch.setattr(vs, "BLOCK", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) if spread is None else rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 16))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x * rng.uniform(0.5, 2, size=(3000, 1)))]
    want = brute(rows)
    got = found(vs.vector_search(spark.createDataFrame(rows, KIND).repartition(7)))
    assert recall(got, want) >= 0.9
    rows = {i: [float(np.float32(c)) for c in v] for i, v, _ in rows}
    assert all(s == vs._exact(np.array([rows[q]]), np.array([rows[j]]))[0] for q in list(got)[:9] for j, s in got[q])


def test_query_reaches_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert recall(found(vs.op2_vector_search(spark, sf_dir)), brute(rows)) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, -0.0], 1) for i in range(100, 700)] + [(i, [2.0, 1.0, 0.0], 1) for i in range(60)]
    rows += [(1000, None, 1), (1020, [0.0, 0.0, 0.0], 1), (1040, [1.0, None, 1.0], 1), (1060, [float("nan"), 1.0, 1.0], 1), (1080, [float("inf"), 1.0, 1.0], 1), (None, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("id", "vector", "key", "rank", "score")}).repartition(5)
    got, want = vs.vector_search(df, success=1.0), brute(rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == want
    assert [j for j, _ in want[100]][:3] == [None, 101, 102]


def test_few_rows_give_all_and_none_give_none(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(0, 60, 5)]
    assert found(vs.vector_search(spark.createDataFrame(rows, KIND))) == brute(rows)
    got = vs.vector_search(spark.createDataFrame([(20, [0.0], 1)], KIND))
    assert got.collect() == [] and got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
