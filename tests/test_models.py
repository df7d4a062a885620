"""Exposure by superposition against a matrix exponential, and the late-event stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksieve.functions import columns as c
from tracksieve.operators import features as ft, split as sp
from tracksieve.session import shared_dir
from tracksieve.streaming import streams


def expm(m):
    scaled, total, term = m / 1024, np.eye(len(m)), np.eye(len(m))
    for i in range(1, 20):
        term = term @ scaled / i
        total = total + term
    for _ in range(10):
        total = total @ total
    return total


def test_three_compartments_match_the_exact_transition(spark):
    iv = spark.createDataFrame([(1, 0.0, 120.0, 10.0, 900.0), (1, 120.0, 300.0, 0.0, 900.0), (1, 300.0, 900.0, 4.0, 900.0)],
                               "caseid bigint, t_from double, t_to double, rate double, horizon double")
    who = (F.lit(40.0), F.lit("male"), F.lit(175.0), F.lit(70.0))
    par = c.minto(*who, 0.0301)
    p = spark.range(1).select(F.lit(1).cast("bigint").alias("caseid"), *[v.alias(n) for n, v in par.items()])
    values = p.first().asDict()
    roots = p.select("caseid", *[v.alias(n) for n, v in ft.modal_parameters({n: F.col(n) for n in par}).items()])
    patients = roots.select("caseid", "ke0", "l1", "l2", "l3", *[v.alias(n) for n, v in ft.modal_coefficients().items()])
    got = ft.three_compartment(iv, patients, F.col("horizon")).first()
    k10, k12, k13 = (values[x] / values["v1"] for x in ("cl1", "cl2", "cl3"))
    k21, k31, ke0 = values["cl2"] / values["v2"], values["cl3"] / values["v3"], values["ke0"]
    a = np.zeros((5, 5))
    a[0, :3] = [-(k10 + k12 + k13), k21, k31]
    a[1, :2], a[2, [0, 2]] = [k12, -k21], [k13, -k31]
    a[3, [0, 3]] = [ke0 / values["v1"], -ke0]
    state = np.array([0, 0, 0, 0, 1.0])
    for start, end, rate in ((0, 120, 10.0), (120, 300, 0.0), (300, 900, 4.0)):
        a[0, 4] = rate
        state = expm(a * (end - start) / 60) @ state
    assert np.isclose(got.plasma, state[0] / values["v1"], rtol=1e-8) and np.isclose(got.effect, state[3], rtol=1e-8)


def reachable_best(sizes):
    """Minimum deviation by listing every reachable pair."""
    cases, subjects = sum(sizes), len(sizes)
    need = [c - s for c, s in zip(sp._nearest_targets(cases, sp.PROPORTIONS), sp._nearest_targets(subjects, sp.PROPORTIONS))]
    pairs = {(0, 0)}
    for e in (s - 1 for s in sizes if s > 1):
        pairs = {p for a, b in pairs for p in ((a + e, b), (a, b + e), (a, b))}
    whole = sum(s - 1 for s in sizes)
    return min(abs(a - need[0]) + abs(b - need[1]) + abs(whole - a - b - need[2]) for a, b in pairs)


@pytest.mark.parametrize("sizes", [[1] * 90 + [2] * 9 + [3], [1, 1, 9], [5, 5, 5, 5], [1, 2, 3, 4, 5, 6, 7], [2] * 13 + [7, 7, 11], [1], [30, 1, 1, 2], [4] * 9 + [3] * 5 + [1]])
def test_feasibility_equals_the_list_of_all_pairs(spark, sizes):
    rows = [(s, sizes.count(s)) for s in sorted(set(sizes))]
    r = sp.feasibility(spark.createDataFrame(rows, "cluster_size bigint, subjects bigint")).first()
    assert (r.cases, r.subjects, r.largest) == (sum(sizes), len(sizes), max(sizes))
    assert r.minimum_deviation == reachable_best(sizes) and r.exact_joint == (r.minimum_deviation == 0)


EVENTS = "caseid bigint, seq bigint, ts timestamp, t double, v double, quality double"


def stream_rows(n=60, seed=3):
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    return sorted(((int(rng.integers(1, 4)), i, float(rng.integers(0, 900)), pick(None, 50.0, 70.0, 120.0), pick(None, 10.0, 60.0, 90.0)) for i in range(n)), key=lambda r: r[2] + rng.random() * 30)


def plain_acceptance(rows, cap, clip):
    out, good = {}, {}
    for c, seq, t, v, q in sorted(rows, key=lambda r: (r[2], r[1])):
        why = ("explicit_missing_event" if v is None else "signal_out_of_range" if not 0 <= v <= 100 else "quality_missing_exact_timestamp" if q is None
               else "quality_below_threshold" if q < 50 else "available")
        if why == "available":
            good[c] = (t, v)
        gt, gv = good.get(c, (None, None))
        if gt is not None and t - gt <= cap:
            out[seq] = (gv, 1.0, min(t - gt, clip), "available")
        else:
            out[seq] = (0.0, 0.0, 0.0, why if gt is None or t > gt else "stale_beyond_cap")
    return out


def feed(spark, rows, folder, files):
    """Rows in arrival order as so many files, one after the other."""
    stamp = F.timestamp_seconds(F.col("t") + 86400.0)
    for part in np.array_split(np.arange(len(rows)), files):
        df = spark.createDataFrame([rows[i] for i in part], "caseid bigint, seq bigint, t double, v double, quality double")
        df.select("caseid", "seq", stamp.alias("ts"), "t", "v", "quality").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("files", [1, 10])
def test_acceptance_stream_is_the_same_in_one_batch_and_in_ten(spark, tmp_path, files):
    rows = stream_rows()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, rows, folder, files)
    streams.close_source(spark, folder, EVENTS)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.append_to_table(streams.acceptance_stream(source, 20.0, 15.0, delay="60 seconds", base=86400.0), out, str(tmp_path / "state"))
    got = spark.read.parquet(out).collect()
    assert len(got) == len(rows)
    assert {r.seq: (r.value, r.mask, r.age, r.reason) for r in got} == plain_acceptance(rows, 20.0, 15.0)
    left = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert left.count() == 0  # every case's state has ended


@pytest.mark.parametrize("files", [1, 10])
def test_sessions_and_ledger_parts_are_the_same_in_one_batch_and_in_ten(spark, tmp_path, files):
    rows = stream_rows(80, 5)
    folder = str(tmp_path / "in")
    feed(spark, rows, folder, files)
    source = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    runs = streams.session_stream(source(), F.col("seq") >= 0, "20 seconds", "60 seconds")
    as_task = F.col("caseid").alias("task"), "seq", F.col("v").cast("string").alias("status"), (F.col("quality") > 50).alias("retryable")
    streams.add_parts(source().select(*as_task), streams.ledger_parts, str(tmp_path / "parts"), str(tmp_path / "s2"))
    ledger = {r.task: r.asDict() for r in streams.ledger_table(spark.read.parquet(str(tmp_path / "parts"))).collect()}
    whole = streams.ledger_parts(spark.read.parquet(folder).select(*as_task)).collect()
    assert ledger == {r.task: r.asDict() for r in whole}
    streams.close_source(spark, folder, EVENTS)
    streams.append_to_table(runs, str(tmp_path / "runs"), str(tmp_path / "s1"))
    got = sorted((r.caseid, r.first_ts.timestamp() - 86400, r.last_ts.timestamp() - 86400, r.rows) for r in spark.read.parquet(str(tmp_path / "runs")).collect())
    want = []
    for c in sorted({r[0] for r in rows}):
        times = sorted(r[2] for r in rows if r[0] == c)
        runs_ = [[times[0]]]
        for t in times[1:]:
            if t - runs_[-1][-1] <= 20:
                runs_[-1].append(t)
            else:
                runs_.append([t])
        want += [(c, x[0], x[-1], len(x)) for x in runs_]
    assert got == want


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark)


def test_checkpoint_cuts_lineage(spark):
    from tracksieve.session import cut_lineage

    df = cut_lineage(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    assert df.count() == 3 and "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("raw,want", [("NA", "missing"), (" nan ", "missing"), ("abc", "invalid"), ("inf", "invalid"), (" 1.5 ", "value"), (None, "missing")])
def test_number_classes(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(c.number_class("x").alias("k")).first().k == want
