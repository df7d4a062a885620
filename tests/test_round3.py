"""Findings of round 3: text of numbers, tables as folders."""

import os
import re
import shutil

from tracksieve import session
from tracksieve.operators import align, ordered, sequence as sq, statistics as st, sweep
from tracksieve.operators.ordered import TASK_ROWS
from tracksieve.plans import fixtures as fx, integrity_plans as ip
from tracksieve.streaming import streams

SF = "/root/testdata/sf0.001"


def test_text_of_a_half_does_not_depend_on_the_order_of_its_sum(spark):
    values = [(0.0915, "0.092"), (0.09149999999999972, "0.092"), (0.09150000000000005, "0.092"), (-0.14649999999999996, "-0.147"), (-0.1465000000000001, "-0.147"),
              (0.8055000000000001, "0.806"), (0.09149, "0.091"), (0.0914999, "0.091"), (-0.0, "0.000"), (None, "")]
    rows = spark.createDataFrame([("x", i, v) for i, (v, _) in enumerate(values)], "metric string, i int, v double")
    got = {r.i: r.v for r in st.formatted(rows, {"other": 1}, ["v"]).collect()}
    assert [got[i] for i in range(len(values))] == [text for _, text in values]


def test_a_table_of_many_files_is_one_entry_of_the_manifest(spark, tmp_path):
    for name in os.listdir(SF):
        shutil.copyfile(f"{SF}/{name}", tmp_path / name)
    for name in ("orders", "region", "events"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.repartition(3).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["name"]: r["verdict"] for r in ip.file_checksums(spark, str(tmp_path)).collect()}
    assert got == {name: {"orders.parquet": "checksum_mismatch", "region.parquet": "unlisted"}.get(name, "ok") for name in os.listdir(SF)}


def test_neighbouring_cases_share_a_state_and_keep_their_own_events(spark, tmp_path):
    schema = "caseid bigint, seq bigint, ts timestamp, t double, v double, quality double"
    cases, folder = range(200, 328), str(tmp_path / "in")
    rows = [(c, c * 10 + k, float(10 * k + c % 3), float(c % 90) if k != 1 else 500.0, 80.0) for c in cases for k in range(1, 4)]
    df = spark.createDataFrame(rows, "caseid bigint, seq bigint, t double, v double, quality double").selectExpr(
        "caseid", "seq", "timestamp_seconds(t + 86400) AS ts", "t", "v", "quality")
    df.repartition(4).write.parquet(folder)
    streams.close_source(spark, folder, schema)
    stream = streams.acceptance_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder), 15.0, 12.0, delay="1000 seconds", base=86400.0)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    got = {r.seq: (r.caseid, r.value, r.mask, r.age, r.reason) for r in spark.read.schema(streams.ACCEPTANCE).parquet(str(tmp_path / "out")).collect()}
    assert got == {c * 10 + k: (c, 0.0 if k == 1 else float(c % 90), float(k > 1), 0.0, "signal_out_of_range" if k == 1 else "available") for c in cases for k in range(1, 4)}


def test_cadence_has_the_measures_of_the_evidence(spark):
    signal, cases = fx.signal(spark, SF, nan=True), fx.cases(spark, SF, inverted=True)
    columns = ["caseid", "track", "median_step", "gap_bound"]
    alone, evidence = (sorted(df.select(columns).collect(), key=lambda r: r[:2]) for df in (sq.track_cadence(signal, cases), sq.track_evidence(signal, cases)))
    assert alone == evidence
    plan = sq.track_cadence(signal, cases)._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" not in plan and "samples" not in plan


def test_tasks_of_a_grid_grow_with_its_points(spark):
    def tasks(points):
        bounds = spark.createDataFrame([(1, 0.0, float(points), 0, points - 1)], "caseid bigint, w0 double, w1 double, lo bigint, hi bigint")
        signal = spark.createDataFrame([(1, "S", 1, 0.0, 1.0)], "caseid bigint, track string, seq bigint, t double, v double")
        plan = align.align_grid(signal, bounds, (align.Lookup("s", "S"),), 1.0)._jdf.queryExecution().optimizedPlan().toString()
        return int(re.search(r"RepartitionByExpression \[caseid#\d+L?, _seg#\d+L?\], (\d+)", plan).group(1))

    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks(1000) == base and tasks(100 * TASK_ROWS) == 100


def test_sweep_counts_of_a_case_without_endpoints_are_zero(spark):
    classes = spark.createDataFrame([(1, "x", 0, 1, 0, 1, 1, 2, 5), (1, "x", 0, 0, 0, 0, 1, 2, 3)],
                                    "caseid bigint, rule string, hs int, ha int, hb int, ts int, ds int, dr int, endpoints bigint")
    cases = spark.createDataFrame([(1,), (2,)], "caseid bigint")
    got = sweep.sweep_counts(classes, cases, ("x", "y"), (10,), (20, 30))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.caseid, r.rule, r.rate_cap): (r.endpoints, r.usable_windows, r.fail_a, r.fail_t) for r in got.collect()}
    assert rows == {(1, "x", 20): (8, 3, 5, 5), (1, "x", 30): (8, 3, 0, 5), **{(c, r, cap): (0, 0, 0, 0) for c, r in ((1, "y"), (2, "x"), (2, "y")) for cap in (20, 30)}}


def test_aggregates_of_recorded_rows_have_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    written = []
    monkeypatch.setattr(align, "cut_lineage", lambda df: written.append(session.cut_lineage(df)) or written[-1])
    rows = [(c, x, i, float(i), 1.0) for c in range(4) for x in "SR" for i in range(100)]
    signal = spark.createDataFrame(rows, "caseid bigint, track string, seq bigint, t double, v double")
    cases = spark.createDataFrame([(c, 0.0, 99.0) for c in range(4)], "caseid bigint, w0 double, w1 double")
    got = align.align_study(signal, cases, ("S", "R"), (align.Lookup("s", "S"),), 1.0)
    slots = next(df for df in written if "s" in df.columns)
    assert len(slots.inputFiles()) > 3 * int(before["spark.sql.shuffle.partitions"])
    assert {k: spark.conf.get(k) for k in before} == before
    assert sorted((r.caseid, r.k, r.s.t) for r in got.collect()) == [(c, i, float(i)) for c in range(4) for i in range(100)]


def test_classes_of_a_grid_need_no_shuffle_of_their_own(spark):
    bounds = spark.createDataFrame([(1, 0.0, 20.0, 0, 20)], "caseid bigint, w0 double, w1 double, lo bigint, hi bigint")
    signal = spark.createDataFrame([(1, n, i, float(i), 1.0) for i, n in enumerate("SAB")], "caseid bigint, track string, seq bigint, t double, v double")
    grid = align.align_grid(signal, bounds, [align.Lookup(n, n) for n in "SAB"], 1.0, before=1, after=1, span=4)
    classes = sweep.endpoint_classes(grid, ("S",), ("A", "B"), (5,), (5,), 2, 1)
    shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (grid, classes)]
    assert shuffles[0] == shuffles[1]
    assert sum(r.endpoints for r in classes.collect()) == 19


def test_joins_of_scenarios_and_counts_have_tasks_by_the_counts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    cases = 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.createDataFrame([(c, x, c % 7) for c in range(cases) for x in "ab"], "caseid bigint, candidate_id string, usable_windows bigint")
    scenarios = spark.createDataFrame([(c, "s", c % 2 == 0, [] if c % 2 == 0 else ["odd"]) for c in range(cases)], "caseid bigint, scenario string, passes boolean, reasons array<string>")
    confusion, reasons = (f(scenarios, counts, (3,)) for f in (sweep.scenario_confusion, sweep.reasons_among_fail_but_meets))
    for df in (confusion, reasons):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert set(re.findall(r"RepartitionByExpression \[caseid#\d+L?\], (\d+)", plan)) == {str(cases * 2 // 10)}
    even, odd = ([c % 7 for c in range(cases) if c % 2 == k] for k in (0, 1))
    cells = (even.count(0), sum(w < 3 for w in even), sum(w >= 3 for w in odd), sum(w >= 3 for w in even), sum(w < 3 for w in odd))
    assert sorted(map(tuple, confusion.collect())) == [("s", x, cells[0], 3, *cells[1:]) for x in "ab"]
    assert sorted(map(tuple, reasons.collect())) == [("s", x, "odd", 3, cells[2]) for x in "ab"]
