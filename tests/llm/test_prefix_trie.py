"""The merged trie against a plain trie over all conversations."""

import hashlib
import random
import zlib

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tracksieve.llm.prefix_trie import EMPTY_HASH, ORACLE, op12_prefix_trie, rebuild, sequences, trie
from tracksieve.plans.registry import Query

KIND = "conv_id long, turn long, role string, text string"


def brute(seqs):
    """Rows of the trie over {id: [(role, text)]}."""
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[:len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        ends = sorted(c for c in own if len(seqs[c]) == len(path))
        out.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), sum(len(q) == len(path) + 1 for q in below), len(childless),
            sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_query_equals_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        ok, message, _ = compare(spark, duck(sf_dir), Query(op12_prefix_trie, ORACLE), sf_dir)
        assert ok, message


def cases():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 30), 100, 101, 217, 218, 219, 10 ** 12 + 3]:
        for turn in range(rng.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "a much longer turn"])))
    rows += [(300, None, None, None), (300, 5, "user", None), (None, 1, "user", "lost"), (301, -2, None, "x"), (301, None, "user", ""), (302, 3, "u", "same"), (302, 4, "u", "same")]
    return rows


@pytest.mark.parametrize("shard,turns", [(1, 100), (3, 1000), (4096, 5), (4096, 1 << 18)])
def test_cases_at_every_shard_size(spark, shard, turns):
    rows = cases()
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("conv", "node", "parent", "depth", "shard", "key", "at")}).repartition(4)
    conv = F.col("conv")
    got = trie(rebuild(sequences(df), F.crc32(conv.cast("string")) % 6, conv - conv % 100, 5), shard=shard, turns=turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rebuilt(rows))


def test_turnless_after_rebuilding_counts_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)  # conversation 100 is absent
    rows = [(c, 0, "user", "one"), (c, 1, "user", "two")]
    conv = F.col("conv")
    got = trie(rebuild(sequences(spark.createDataFrame(rows, KIND)), F.crc32(conv.cast("string")) % 6, conv - conv % 100, 5)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_identical_long_conversations(spark):
    rows = [(c, t, "user", "turn " * (t % 3)) for c in (1, 2, 3) for t in range(500)]
    got = trie(sequences(spark.createDataFrame(rows, KIND)), shard=2).orderBy("depth").collect()
    assert len(got) == 501 and {r.n_convs for r in got} == {3} and got[0].n_leaves == 1
    assert got[0].saved_tokens == 2 * sum(5 * (t % 3) for t in range(500))
    assert got[-1].ends_sha256 == hashlib.sha256(b"1,2,3").hexdigest() and got[3].ends_sha256 == EMPTY_HASH


def test_empty_table(spark):
    assert trie(sequences(spark.createDataFrame([(None, 1, "a", "b")], KIND))).collect() == []
