"""A table is visible only after its gates, and a failing attempt leaves the old one."""

from tracksieve.sources.publish import publish, published


def test_only_a_table_that_passes_every_gate_is_visible(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows, names="k bigint, v double": spark.createDataFrame(rows, names)
    keys = make([(1, 0.0), (2, 0.0), (3, 0.0)])
    rules = dict(rows=3, not_null=("k",), finite=("v",), key=("k",), cover=keys)
    failed = lambda gates: {g.gate: g.observed for g in gates if not g.passed}
    assert published(spark, path) is None
    assert failed(publish(make([(1, 1.0), (2, float("inf")), (None, 2.0)]), path, ("k", "v"), **rules)) == {
        "null_k": 1, "non_finite_v": 1, "missing_keys": 1, "extra_keys": 1}
    assert published(spark, path) is None
    assert failed(publish(make([(1, 1.0), (2, 2.0), (3, 3.0)]), path, ("k", "v"), **rules)) == {}
    assert sorted(map(tuple, published(spark, path).collect())) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert failed(publish(make([(1, 1.0), (2, 2.0), (2, 2.5), (4, 3.0)]), path, ("k", "v"), **rules)) == {
        "rows": 4, "repeated_keys": 1, "missing_keys": 1, "extra_keys": 1}
    assert failed(publish(make([(1.0, 1), (2.0, 2), (3.0, 3)], "v double, k bigint"), path, ("k", "v"), **rules)) == {"column_order": 1}
    assert sorted(r.v for r in published(spark, path).collect()) == [1.0, 2.0, 3.0]
    assert failed(publish(make([(3, 9.0), (1, 7.0), (2, 8.0)]), path, ("k", "v"), **rules)) == {}
    assert sorted(r.v for r in published(spark, path).collect()) == [7.0, 8.0, 9.0]
