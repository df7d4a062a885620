"""Product codes against plain integer k-means in Python."""

import hashlib
import math

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tracksieve.llm.vector_codes import ORACLE, integers, nearest, op13_vector_codes, products, vector_codes
from tracksieve.plans.registry import Query

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{(id, label): sorted (code, error)}, codebook hash."""
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    if not rows:
        return [], None
    wide = -(-max(len(v) for _, v, _ in rows) // parts)
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in v] + [0] * (wide * parts - len(v)) for _, v, _ in rows]
    cut = [[v[p * wide:(p + 1) * wide] for v in ints] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(v, e), k) for k, e in enumerate(books[p])) for v in cut[p]] for p in range(parts)]
    for _ in range(rounds):
        for p, found in enumerate(assign()):
            for k in range(len(books[p])):
                own = [v for v, (_, at) in zip(cut[p], found) if at == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    final = assign()
    coded = [(i, lab, "".join(f"{final[p][n][1]:02x}" for p in range(parts)), sum(final[p][n][0] for p in range(parts))) for n, (i, _, lab) in enumerate(rows)]
    total = {}
    for _, lab, _, e in coded:
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(total[lab]), digest) for i, lab, c, e in coded), key=repr), digest


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    ok, message, _ = compare(spark, duck(sf_dir), Query(op13_vector_codes, ORACLE), sf_dir)
    assert ok, message


@pytest.mark.parametrize("largest", [10, 1 << 20, 1 << 26, 1 << 29])
def test_products_are_exact(largest):
    rng = np.random.default_rng(7)
    a, c = rng.integers(-largest, largest + 1, (37, 13)), rng.integers(-largest, largest + 1, (11, 13))
    a[0], c[0] = -largest, -largest
    assert (products(a, c).astype(object) == a.astype(object) @ c.astype(object).T).all()


def test_nearest_takes_the_first_of_equal_entries_small_and_huge():
    book = np.array([[5, 5], [0, 0], [2, 0], [0, 0]])
    at, far = nearest(np.array([[1, 0], [0, 0], [6, 6]]), book)
    assert at.tolist() == [1, 1, 0] and far.tolist() == [1, 0, 2]
    at, far = nearest(np.array([[1 << 70, 0], [0, 1]], dtype=object), book)
    assert at.tolist() == [0, 1] or at.tolist() == [2, 1]
    assert far[0] == min((2 ** 70 - x) ** 2 + y ** 2 for x, y in book.tolist())


def test_integers_floor_down_at_every_magnitude():
    x = np.array([[-0.0001, 0.0, 0.9999], [1e30, -1e30, 2.5]])
    assert integers(x, 1024).tolist() == [[math.floor(1024 * v) for v in r] for r in x.tolist()]


def rows_of_cases():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)], int(i) % 3 if i % 5 else None) for i in rng.permutation(60)]
    rows += [rows[0], rows[0], (7, [0.5] * 6, 1), (None, [0.25, -0.25], 2), (61, [], None), (62, None, 1), (63, [1.0, None], 1), (64, [float("nan")] * 6, 1),
             (65, [float("-inf")] * 6, None), (66, [-1e-9] * 6, 0)]
    return rows


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_cases(spark, broadcast):
    rows = rows_of_cases()
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("id", "vector", "code", "error", "_key", "part", "label_error")}).repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = vector_codes(df, entries=16)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, entries=16)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_huge_components_and_few_rows(spark):
    rows = [(1, [3e38, -3e38, 1e12, 0.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [-3e38, 7e8, 1e20, -1.0], 2), (4, [3e38, 0.0, 0.0, 0.0], 2)]
    got = vector_codes(spark.createDataFrame(rows, KIND), entries=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, entries=2)[0]


def test_empty_table(spark):
    got = vector_codes(spark.createDataFrame([(1, None, 2)], KIND))
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert got.collect() == []
