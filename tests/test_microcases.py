"""Literal micro-cases with known results; each runs on tiny segments as well as the default."""

import math

import pytest
from pyspark.sql import functions as F

from tracksieve.operators import align, features, guards, quality, sequence as sq, split as sp, statistics as st, sweep

NAN = float("nan")


def track(spark, rows, name="S", case=1):
    return spark.createDataFrame([(case, name, i, float(t), None if v is None else float(v)) for i, (t, v) in enumerate(rows, 1)],
                                 "caseid bigint, track string, seq bigint, t double, v double")


def window(spark, w0, w1, case=1):
    return spark.createDataFrame([(case, float(w0), float(w1))], "caseid bigint, w0 double, w1 double")


@pytest.mark.parametrize("span", [2, 1 << 20])
def test_dedupe_keeps_last_finite_row(spark, span):
    from tracksieve.operators.ordered import previous_row, segmented

    s = track(spark, [(0, 10), (10, 20), (10, 30), (5, 40), (10, NAN)])
    c = window(spark, 0, 20)
    got = [(r.t, r.v, r.dup) for r in align.dedupe_last_finite(s, c).orderBy("t").collect()]
    assert got == [(0.0, 10.0, False), (5.0, 40.0, False), (10.0, 30.0, True)]
    n = align.index_counters(previous_row(segmented(s, "seq", span), ["caseid", "track"], "seq", ["t"]), c).first()
    assert (n.duplicate_timestamp_count, n.zero_interval_count, n.negative_interval_count, n.finite_row_count) == (2, 1, 1, 4)


def bounds(spark, w0, w1, step):
    return spark.createDataFrame([(1, float(w0), float(w1), 0, int((w1 - w0) // step))], "caseid bigint, w0 double, w1 double, lo bigint, hi bigint")


@pytest.mark.parametrize("span", [2, 3, 4096])
def test_asof_with_quality(spark, span):
    s = track(spark, [(0, 5), (10, 50), (20, 101), (30, 60)], "SIG").unionByName(track(spark, [(10, 50), (30, 19)], "Q"))
    looks = (align.Lookup("none", "SIG", 0, 100), align.Lookup("ge20", "SIG", 0, 100, "Q", 20.0))
    a = align.align_grid(s, bounds(spark, 0, 30, 5), looks, 5.0, span=span).where("_home")
    rows = {r.g: (r.a, r.b) for r in a.select("g", align.capped("none", 10).alias("a"), align.capped("ge20", 20).alias("b")).collect()}
    assert [rows[g] for g in (0.0, 5.0, 10.0, 25.0, 30.0)] == [(True, False), (True, False), (True, True), (False, True), (True, True)]


@pytest.mark.parametrize("span", [4, 4096])
def test_negative_latest_value_blocks(spark, span):
    s = track(spark, [(0, 1), (10, -1), (20, 0), (30, 1), (30, 2)], "R")
    a = align.align_grid(s, bounds(spark, -1, 100, 1), (align.Lookup("r", "R"),), 1.0, before=2, after=1, span=span).where("_home")
    state = {r.g: r.s for r in a.select("g", align.blocking_state("r", 30.0).alias("s")).collect()}
    assert [state[g] for g in (-1.0, 0.0, 10.0, 20.0, 30.0, 100.0)] == [0, 2, 0, 1, 4, 0]


def test_grid_is_anchored_and_clipped(spark):
    spans = spark.createDataFrame([(1, -3.0, 107.0, 0.0, 103.0), (2, 0.0, 9.0, None, None), (3, 0.0, 100.0, 50.0, 20.0)],
                                  "caseid bigint, w0 double, w1 double, s0 double, s1 double")
    g = [r.g for r in align.grid_points(align.grid_bounds(spans, 10.0), 10.0).orderBy("g").collect()]
    assert (g[0], g[-1], len(g)) == (7.0, 97.0, 10)


@pytest.mark.parametrize("span", [4, 4096])
def test_sweep_has_sixty_candidates_of_three_windows(spark, span):
    points = [(t, 50) for t in range(0, 101, 10)]
    s = track(spark, points, "SIG")
    for name in ("Q", "A", "B"):
        s = s.unionByName(track(spark, points if name != "Q" else [(t, 90) for t, _ in points], name))
    rules = {"none": None, "ge_20": 20.0, "ge_50": 50.0, "ge_80": 80.0}
    looks = [align.Lookup(n, "SIG", 0, 100, None if q is None else "Q", q) for n, q in rules.items()] + [align.Lookup("a", "A"), align.Lookup("b", "B")]
    c = window(spark, 0, 100)
    b = align.grid_bounds(align.common_span(s, c, ("SIG", "A", "B")), 10.0)
    a = align.align_grid(s, b, looks, 10.0, before=5, after=3, span=span)
    cl = sweep.endpoint_classes(a, tuple(rules), ("a", "b"), (10, 20, 30), (30, 60, 120, 300, 600), 6, 3)
    n = sweep.sweep_counts(cl, c, tuple(rules), (10, 20, 30), (30, 60, 120, 300, 600)).collect()
    assert len(n) == 60 and {r.usable_windows for r in n} == {3} and {r.duplicate_affected for r in n} == {0}


@pytest.mark.parametrize("span", [2, 1 << 20])
def test_adaptive_runs(spark, span):
    e = sq.track_evidence(track(spark, [(t, 1) for t in (0, 1, 1, 2, 10, 11)]), window(spark, 0, 100), span).first()
    assert (e.median_step, e.gap_bound, e.runs, e.longest_seconds, e.total_seconds) == (1.0, 3.0, 3, 1.0, 3.0)
    assert (e.duplicate_timestamps, e.zero_intervals, e.long_gaps) == (1, 1, 1)
    assert list(e.flags) == ["duplicate_timestamp", "long_gap", "zero_interval"]


@pytest.mark.parametrize("span", [2, 1 << 20])
def test_backward_time_breaks_a_run(spark, span):
    e = sq.track_evidence(track(spark, [(t, 1) for t in (0, 2, 1, 3)]), window(spark, 0, 100), span).first()
    assert (e.negative_intervals, e.longest_seconds) == (1, 2.0)


def test_inverted_window_is_empty_and_flagged(spark):
    e = sq.track_evidence(track(spark, [(1, 1), (2, 1)]), window(spark, 10, 0)).first()
    assert (e.samples, e.positive, list(e.flags)) == (0, 0, ["inverted_window"])


@pytest.mark.parametrize("span", [3, 1 << 20])
def test_fixed_runs(spark, span):
    rows = [(0, 1), (1, 1), (2, 1), (40, 1), (41, 0), (42, 0), (42, 0), (43, 1)]
    r = sq.with_adaptive_bound(sq.with_previous(sq.inside(sq.rows_of(track(spark, rows), window(spark, 0, 100), span))))
    got = {(x.predicate, x.boundary): x for x in sq.bounded_runs(r, sq.POSITIVE_AND_ZERO, sq.fixed_and_adaptive_bounds()).collect()}
    assert [got["positive", b].longest_seconds for b in ("adaptive", "fixed_30", "fixed_60")] == [2.0, 2.0, 40.0]
    assert got["positive", "fixed_30"].runs == 3 and got["zero", "fixed_30"].runs == 2
    assert sq.interval_stats(r).first().zero_intervals == 1


def test_window_position_in_recorded_order(spark):
    rows = [(-1, 5), (0, 0), (10, 50), (10, 60), (5, 110), (101, 20)]
    r = sq.rows_of(track(spark, rows), window(spark, 0, 100))
    p = sq.window_position(r).first()
    assert (p.rows, p.rows_before, p.rows_inside, p.rows_after, p.first_inside, p.last_inside) == (6, 1, 4, 1, 0.0, 5.0)
    i = sq.interval_stats(sq.with_previous(sq.inside(r))).first()
    assert (i.duplicate_timestamps, i.zero_intervals, i.negative_intervals) == (1, 1, 1)
    s = sq.range_shares(sq.inside(r)).first()
    assert (s.equal_zero, s.above_100) == (1, 1)


def test_quality_shares(spark):
    q = sq.quality_shares(track(spark, [(i, v) for i, v in enumerate((-1, 20, 50, 80, 101))]).withColumn("x", F.col("v"))).first()
    assert (q.negative, q.above_100, q.share_ge_50) == (1, 1, 3 / 5)


def test_naive_runs_ignore_gaps(spark):
    r = sq.rows_of(track(spark, [(0, 1), (1, 1), (500, 1), (501, 0), (502, None), (503, 2)]), window(spark, 0, 1000), 2)
    n = sq.naive_runs(r).first()
    assert (n.runs, n.longest_seconds) == (2, 500.0)


def test_episode_metrics(spark):
    t = spark.createDataFrame([(1, "P0S0", i, x, r, 1.0) for i, (x, r) in enumerate(((30.0, 0.0), (50.0, 3.0), (70.0, 6.0)))],
                              "caseid bigint, condition_id string, step bigint, x double, rate double, score double")
    m = st.episode_metrics(t, span=2).first()
    assert math.isclose(m.mean_absolute_deviation, 40 / 3) and (m.seconds_below, m.seconds_in_range, m.seconds_above) == (10.0, 10.0, 10.0)
    assert m.total_amount == 1.5 and m.mean_absolute_rate_change == 3.0


def test_contrasts_need_complete_cases(spark):
    vals = {"P0S0": 10.0, "P1S0": 8.0, "P0S1": 7.0, "P1S1": 4.0}
    rows = [(case, subj, c, v) for case, subj in ((1, 1), (2, 1), (3, 2)) for c, v in vals.items()] + [(4, 3, "P0S0", 1.0)]
    c = st.case_contrasts(spark.createDataFrame(rows, "caseid bigint, subjectid bigint, condition_id string, m double"), ["m"])
    got = {(r.caseid, r.contrast): r.value for r in c.collect()}
    assert got[1, "P1S0_minus_P0S0"] == -2.0 and got[1, "interaction"] == -1.0 and {k for (k, _), v in got.items() if v is None} == {4}
    assert {r.subjectid for r in st.subject_contrasts(c).collect() if r.cases} == {1, 2}


def test_holm_step_down(spark):
    p = spark.createDataFrame([("m", "a", .01), ("m", "b", .04), ("m", "c", .03)], "metric string, contrast string, p double")
    got = {r.contrast: round(r.adjusted_p, 10) for r in st.holm(p).collect()}
    assert got == {"a": .03, "b": .06, "c": .06}


def test_hamilton_quotas_give_spare_slots_by_remainder_then_order(spark):
    n = sp.canonical_strata(spark).withColumn("subjects", F.when(F.col("ord") <= 3, 4).when(F.col("ord") == 4, 3).otherwise(0).cast("bigint"))
    q = {r.ord: r.quota for r in sp.hamilton_quotas(n).collect()}
    assert [q[i] for i in range(1, 5)] == [1, 1, 1, 0] and sum(q.values()) == 3


def test_schedule_merges_equal_rates_and_starts_at_zero(spark):
    obs = spark.createDataFrame([(1, 5.0, 2.0), (1, 7.0, 2.0), (1, 9.0, 0.0), (2, 0.0, 0.0), (2, 3.0, 1.0)], "caseid bigint, t double, v double")
    cases = window(spark, 0, 20).unionByName(window(spark, 0, 20, 2)).unionByName(window(spark, 0, 20, 3))
    s = features.step_schedule(obs, cases, F.col("v"), rows=2)
    got = sorted((r.caseid, r.t, r.rate) for r in s.collect())
    assert got == [(1, 0.0, 0.0), (1, 5.0, 2.0), (1, 9.0, 0.0), (2, 0.0, 0.0), (2, 3.0, 1.0), (3, 0.0, 0.0)]
    iv = features.schedule_intervals(s, cases, rows=2)
    d = {r.caseid: r.total_amount for r in features.dose_integrals(iv, minute=1.0).collect()}
    assert d == {1: 8.0, 2: 17.0, 3: 0.0}


def test_null_metric_fails_a_scenario_and_counts_as_missing(spark):
    r = spark.createDataFrame([(1, None), (2, 5.0)], "caseid bigint, m double")
    got = {x.caseid: (x.passes, list(x.reasons)) for x in quality.scenario_results(r, {"s": (("m_low", "m", ">=", 1),)}).collect()}
    assert got == {1: (False, ["m_low"]), 2: (True, [])}
    row = quality.marginal_sweep(r, (("c", "m", ">=", 1),)).first()
    assert (row.pass_count, row.fail_count, row.missing_count) == (1, 1, 1)


def test_completeness_reports_every_kind(spark):
    rows = spark.createDataFrame([(1,), (1,), (9,)], "caseid bigint")
    got = {(r.caseid, r.problem) for r in guards.completeness(rows, guards.expected_universe(spark, 1, 2)).collect()}
    assert got == {(1, "duplicate"), (2, "missing"), (9, "extra")}
