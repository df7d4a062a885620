"""The registered text queries: against their oracles, and op1 and op10 by brute force."""

import random

import numpy as np
import pytest

import __spark_entry__ as contract
from oracle import compare, duck
from test_corpus import _check_bins
from tracksieve.llm.sharding import minimax_cuts
from tracksieve.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_quality_rules", "op7_mixing"])
def test_text_query_equals_oracle(spark, name):
    assert name in contract.queries() and name in contract.oracle_sql()
    ok, message, _ = compare(spark, duck(SF), all_queries()[name], SF)
    assert ok, message


def test_shards_are_minimax_by_brute_force(spark):
    def best(sizes, shards):
        if shards == 1 or len(sizes) <= 1:
            return sum(sizes)
        return min(max(sum(sizes[:i]), best(sizes[i:], shards - 1)) for i in range(1, len(sizes) + 1))

    rng = random.Random(5)
    for shards in (1, 2, 3):
        groups = {rng.randrange(-(1 << 63), 1 << 63): rng.randrange(1, 30) for _ in range(9)}
        df = spark.createDataFrame(list(groups.items()), "_key long, _size long")
        cuts, capacity = minimax_cuts(df, shards)
        ordered = sorted(groups)
        assert capacity == best([groups[k] for k in ordered], shards)
        parts = np.bincount([sum(k >= c for c in cuts) for k in ordered], [groups[k] for k in ordered])
        assert len(parts) <= shards and parts.max() == capacity


def test_op1_keeps_every_row_and_equal_texts_together(spark):
    rows = contract.queries()["op1_sharding"](spark, SF).toPandas()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    both = rows.merge(texts, on="doc_id")
    assert len(rows) == len(texts) == len(both) and both.groupby("text")["shard"].nunique().max() == 1
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])


def test_op10_places_all_documents(spark):
    rows = contract.queries()["op10_packing"](spark, SF).collect()
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    _check_bins(rows, 2048)
    got = dict.fromkeys(words, 0)
    for r in rows:
        got[r["doc_id"]] += r["size"]
    assert got == words
