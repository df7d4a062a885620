"""Repeated passages against all strings of 50 bytes in a dictionary."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksieve.llm import repeated_passages as rp

KIND = "doc_id long, text string"


def brute(rows):
    last = rp.NEVER
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - rp.LENGTH + 1):
            s = b[p:p + rp.LENGTH]
            first[s] = min(first.get(s, last), last if i is None else i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - rp.LENGTH + 1):
            if first[b[p:p + rp.LENGTH]] < (last if i is None else i):
                gone[p:p + rp.LENGTH] = b"\1" * rp.LENGTH
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_texts():
    rng = np.random.default_rng(4)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(300)] + ["ü", "日本", "\0", ""]
    text = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    line = text(30)
    rows = [(int(i), text(int(rng.integers(0, 60)))) for i in rng.permutation(60)]
    rows += [(100 + i, text(12) + line + text(12)) for i in range(40)]  # one line, different neighbours
    rows += [(200 + i, rows[3][1] + line[:49]) for i in range(12)]  # copies; one byte too short
    rows += [(300, line[:50]), (301, line[:49]), (302, line[1:51] * 3), (303, None), (304, ""), (None, line), (None, text(40)), (305, "a" * 400), (306, "a" * 60 + "b" + "a" * 49),
             (307, "\0" * 70), (308, "\0" * 49 + "x"), (309, "\0" * 60), (100, line + line), (299, "é" * 25 + "z"), (298, "é" * 25)]
    return rows


@pytest.mark.parametrize(("pack", "group", "crowd"), [(rp.PACK, rp.GROUP, rp.CROWD), (700, 300, rp.CROWD), (700, 300, 4), (900, 1 << 20, 1)])
def test_equals_all_strings(spark, pack, group, crowd):
    rows = odd_texts()
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("id", "pack", "group", "bytes", "total", "kind", "least")}).repartition(3)
    got = rp.repeated_passages(df, pack_bytes=pack, group_bytes=group, crowd=crowd)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found(got) == brute(rows)


def test_query_equals_all_strings(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    assert found(rp.op8_repeated_passages(spark, sf_dir)) == want


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([700, 0, 49, 50, 51, 900, 3])
    data = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    whole = rp.anchors(data, sizes)
    monkeypatch.setattr(rp, "CHUNK", 64)
    for a, b in zip(whole, rp.anchors(data, sizes)):
        assert a.tolist() == b.tolist()


def test_no_documents(spark):
    assert rp.repeated_passages(spark.createDataFrame([], KIND)).collect() == []
