"""Contrasts that name every bad case, and replicate vectors against the plain definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksieve.operators import resampling as rs, statistics as st

ROWS = "caseid bigint, subjectid bigint, condition_id string, m double"
CONDITIONS = st.CONDITIONS


def full(case, subject, base=0.0):
    return [(case, subject, c, base + 10.0 ** i) for i, c in enumerate(CONDITIONS)]


def test_every_bad_case_has_rows_with_its_reason(spark):
    rows = full(1, 1) + full(2, 1, 5.0)
    rows += full(3, 2)[:3] + [(3, 2, "P0S0", 7.0)]  # a repeated condition hides the missing one if rows are only counted
    rows += full(4, 2)[:3]
    rows += full(5, 3)[:3] + [(5, 3, "P1S1", float("nan"))]
    rows += full(6, 3) + [(6, 3, "P9", 1.0)]
    rows += full(7, 4)[:3] + [(7, 5, "P1S1", 1.0)]
    rows += [(8, None, c, 1.0) for c in CONDITIONS]
    rows += full(9, 6)[:3] + [(9, 6, None, 1.0)]
    got = st.case_contrasts(spark.createDataFrame(rows, ROWS), ["m"])
    assert got.count() == 9 * len(st.CONTRASTS)
    why = {r.caseid: r.reason for r in got.collect()}
    assert why == {1: "", 2: "", 3: "duplicate_condition", 4: "missing_condition", 5: "non_finite_value", 6: "unknown_condition",
                   7: "several_subjects", 8: "subject_missing", 9: "unknown_condition"}
    assert all((r.value is None) == (r.reason != "") for r in got.collect())
    by = {(r.subjectid, r.contrast): (r.value, r.cases, r.excluded_cases) for r in st.subject_contrasts(got).collect()}
    assert by[1, "interaction"] == (1 - 10 - 100 + 1000.0, 2, 0) and by[2, "interaction"] == (None, 0, 2)


def plain(values, replicates, seed, weights):
    subjects = np.array(sorted(values), dtype=np.int64)
    w = weights(rs.draws(subjects, replicates, seed))
    v = np.array([values[s] for s in subjects.tolist()])
    return w.T @ v, w.sum(axis=0)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_vectors_do_not_depend_on_partitions(spark, partitions):
    values = {int(s): float(v) for s, v in zip(np.random.default_rng(1).permutation(5000)[:700] - 100, np.arange(700))}
    wide = spark.createDataFrame([(s, v, None if s % 3 else v) for s, v in values.items()] + [(None, 1.0, 1.0)], "subjectid bigint, v0 double, v1 double").repartition(partitions)
    for weights in (rs.poisson_counts, rs.signs):
        got = {r.measure: r for r in rs.replicate_vectors(wide, ["v0", "v1"], weights, 300, 5).collect()}
        for name, own in (("v0", values), ("v1", {s: v for s, v in values.items() if s % 3 == 0})):
            totals, sums = plain(own, 300, 5, weights)
            assert np.allclose(got[name].totals, totals) and np.allclose(got[name].weights, sums)


def test_draws_follow_their_laws():
    u = rs.draws(np.arange(4000), 500, 1)
    n = rs.poisson_counts(u)
    assert abs(n.mean() - 1) < 5e-3 and abs(n.var() - 1) < 1e-2 and abs((n == 0).mean() - np.exp(-1)) < 2e-3
    assert abs(rs.signs(u).mean()) < 3e-3
    assert abs(np.corrcoef(n[:, 0], n[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(n[0], n[1])[0, 1]) < 0.15


def test_interval_agrees_with_a_plain_bootstrap(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, 400)
    rows = spark.createDataFrame([(i, "m", "c", float(v)) for i, v in enumerate(x)] + [(400, "m", "c", None)], "subjectid bigint, metric string, contrast string, value double")
    got = st.bootstrap_ci(rows, [("m", "c")]).first()
    means = rng.choice(x, (2000, 400)).mean(axis=1)
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(means, [.025, .975]), atol=0.05)
    shifted = rows.withColumn("value", F.col("value") - float(x.mean()))
    assert st.sign_flip(shifted, [("m", "c")]).first().p > 0.9
    assert st.sign_flip(rows, [("m", "c")]).first().p == 1 / 2001


def test_formatting_has_no_cap_on_digits(spark):
    t = spark.createDataFrame([("a", 0.125, None), ("b", 1 / 3, 2.5)], "metric string, x double, y double")
    got = {r.metric: (r.x, r.y) for r in st.formatted(t, {"a": 2, "b": 9}, ["x", "y"]).collect()}
    assert got == {"a": ("0.13", ""), "b": ("0.333333333", "2.500000000")}
