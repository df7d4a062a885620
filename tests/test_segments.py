"""Segmented operators against plain whole-key windows, on skewed random rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracksieve.functions import quantiles as qt
from tracksieve.operators import align, checksums, ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; order values are sparse."""
    rng = random.Random(3)
    seqs = rng.sample(range(2000), 400)
    rows = [(1 if rng.random() < .5 else rng.randrange(2, 9), s, rng.choice([None, 1.0, 1.0, 2.0, 3.5]), rng.randrange(5)) for s in seqs]
    return spark.createDataFrame(rows, "k bigint, o bigint, v double, n bigint").cache()


def whole():
    return Window.partitionBy("k").orderBy("o")


@pytest.mark.parametrize("span", [1, 13, 1 << 20])
def test_previous_next_running_last(spark, skewed, span):
    s = od.segmented(skewed, "o", span)
    up_to = whole().rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("k", "o", F.lag("v").over(whole()).alias("a"), F.lead("v").over(whole()).alias("b"),
                         F.sum("n").over(up_to).alias("c"), F.last("v", ignorenulls=True).over(up_to).alias("d"))
    got = od.previous_row(s, ["k"], "o", ["v"], "p").select("k", "o", F.col("p.v").alias("a")).join(
        od.next_row(s, ["k"], "o", ["v"], "p").select("k", "o", F.col("p.v").alias("b")), ["k", "o"]).join(
        od.running_sum(s, ["k"], "o", {"c": F.col("n")}).select("k", "o", "c"), ["k", "o"]).join(
        od.last_known(s.withColumn("d", F.col("v")), ["k"], "o", {"d": F.col("v")}).select("k", "o", "d"), ["k", "o"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("span", [1, 17, 1 << 20])
def test_islands_and_ranks(skewed, span):
    s = od.segmented(skewed, "o", span)
    start = F.coalesce(F.col("v") != F.col("prev.v"), F.lit(True)) | F.col("v").isNull()
    p = od.previous_row(s, ["k"], "o", ["v"])
    got = sorted((r.k, r.a, r.z, r.c) for r in od.islands(p, ["k"], "o", start, sums={"c": F.lit(1)}, mins={"a": F.col("o")}, maxs={"z": F.col("o")}).collect())
    lag = F.lag("v").over(whole())
    marked = skewed.withColumn("st", F.when(F.coalesce(F.col("v") != lag, F.lit(True)) | F.col("v").isNull(), 1).otherwise(0))
    want = sorted((r.k, r.a, r.z, r.c) for r in marked.withColumn("g", F.sum("st").over(whole().rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "g").agg(
        F.min("o").alias("a"), F.max("o").alias("z"), F.count(F.lit(1)).alias("c")).collect())
    assert got == want
    r = sorted((x.k, x.o, x.rank) for x in od.ranked(s, ["k"], ["o"]).collect())
    assert r == sorted((x.k, x.o, x.rank) for x in skewed.withColumn("rank", F.row_number().over(whole())).collect())


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_joins_do_not_depend_on_the_broadcast_threshold(spark, skewed, threshold):
    small = spark.createDataFrame([(i, i * 10) for i in range(1, 8)], "k bigint, w bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        want = sorted((r.k, r.o, r.k * 10) for r in skewed.where("k < 8").collect())
        assert sorted((r.k, r.o, r.w) for r in od.spread_join(skewed, small, ["k"], "o").collect()) == want
        assert sorted((r.k, r.o, r.w) for r in od.attach(od.segmented(skewed, "o", 50), small, ["k"], ["k"]).collect()) == want
        left = od.spread_join(skewed, small, ["k"], "o", "left")
        assert left.count() == skewed.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("resolution", [0.5, 4096])
def test_quantiles_match_their_definitions(spark, resolution):
    rng = np.random.default_rng(5)
    groups = {1: rng.normal(0, 100, 501).round(2), 2: np.array([4.0]), 3: rng.integers(-3, 3, 200).astype(float), 4: np.exp(rng.normal(0, 8, 77))}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [(5, None)], "k bigint, x double")
    counts = qt.value_counts(df, ["k"], "x")
    wanted = {"n10": (.1, "nearest"), "n50": (.5, "nearest"), "l25": (.25, "linear"), "l90": (.9, "linear"), "r90": (.9, "rounded")}
    got = {r.k: r for r in qt.quantiles_of_counts(counts, ["k"], "x", wanted, resolution=resolution).collect()}
    for k, v in groups.items():
        s = np.sort(v)
        assert got[k].n == len(s)
        assert got[k].n10 == s[max(1, int(np.ceil(.1 * len(s)))) - 1] and got[k].n50 == s[max(1, int(np.ceil(.5 * len(s)))) - 1]
        assert np.isclose(got[k].l25, np.quantile(s, .25)) and np.isclose(got[k].l90, np.quantile(s, .9))
        assert got[k].r90 == s[round(.9 * (len(s) - 1))]
    assert got[5].n == 0 and got[5].n50 is None


def crowded():
    """Distributions whose values pile up in one segment: close together, a day of epoch seconds, tiny, huge, both signs, ties."""
    rng = np.random.default_rng(9)
    return {
        "close": 7.0 + np.arange(3000) * 3e-9, "epoch": 1.7e9 + rng.permutation(3000) * 28.8, "tiny": 10.0 ** -rng.uniform(4, 300, 2500),
        "huge": rng.choice([-1, 1], 2500) * 10.0 ** rng.uniform(200, 308, 2500), "signs": np.concatenate([rng.normal(0, 1e-7, 2000), [0.0] * 500, [-0.0] * 20]),
        "ties": rng.integers(0, 900, 3000) * 1e-6, "edge": np.array([5e-324, 1e-323, 1.5e-323, 2e-323] * 3 + list(np.arange(200) * 5e-324))}


@pytest.mark.parametrize("limit,threshold", [(16, "10MB"), (16, "-1"), (700, "10MB")])
def test_crowded_segments_are_split_until_they_are_small(spark, limit, threshold):
    groups = crowded()
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [(None, 1.0), (None, 3.0)], "k string, x double").repartition(5)
    wanted = {"n01": (.01, "nearest"), "n50": (.5, "nearest"), "n99": (.99, "nearest"), "l37": (.37, "linear"), "r90": (.9, "rounded")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.k: r for r in qt.quantiles_of_counts(qt.value_counts(df, ["k"], "x"), ["k"], "x", wanted, limit=limit).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got[None].n == 2 and got[None].n50 == 1.0 and got[None].n99 == 3.0
    for k, v in groups.items():
        s = np.sort(v)
        for name, p in (("n01", .01), ("n50", .5), ("n99", .99)):
            assert got[k][name] == s[max(1, int(np.ceil(p * len(s)))) - 1], (k, name)
        assert got[k].r90 == s[round(.9 * (len(s) - 1))], k
        at = .37 * (len(s) - 1)
        low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
        assert min(low, high) <= got[k].l37 <= max(low, high), k


def test_hundred_thousand_values_within_a_hair(spark):
    df = spark.range(100_000).select((F.lit(1.0) + F.col("id") * 1e-10).alias("x"))
    row = qt.exact_quantiles(df, [], "x", {"a": .25, "b": .75}).first()
    assert (row.a, row.b, row.n) == (1.0 + 24_999 * 1e-10, 1.0 + 74_999 * 1e-10, 100_000)


@pytest.mark.parametrize("span", [3, 7, 4096])
def test_grid_alignment_does_not_depend_on_segments(spark, span):
    rng = random.Random(11)
    rows = [(case, rng.choice(["S", "R"]), i, float(rng.randrange(0, 300)), rng.choice([None, -1.0, 5.0, 50.0, 120.0]))
            for case in (1, 2) for i in range(120 if case == 1 else 9)]
    s = spark.createDataFrame(rows, "caseid bigint, track string, seq bigint, t double, v double")
    b = spark.createDataFrame([(1, 0.0, 300.0, 2, 28), (2, 0.0, 300.0, 5, 20)], "caseid bigint, w0 double, w1 double, lo bigint, hi bigint")
    looks = (align.Lookup("s", "S", 0, 100), align.Lookup("r", "R"))

    def result(n):
        a = align.align_grid(s, b, looks, 10.0, before=5, after=3, span=n)
        ok = align.capped("s", 40)
        return sorted(map(tuple, align.usable_windows(a, ok, [align.blocking_state("r", 60) > 0], 6, 3).collect())), sorted(
            map(tuple, a.where("_home").select("caseid", "slot", "s.t", "r.t", "r.v").collect()), key=str)

    assert result(span) == result(1 << 20)


def plain_asof(rows, w0, w1, step, lo, hi):
    """Per grid point the last accepted row, by a plain walk over the sorted rows."""
    last = {}
    for track, seq, t, v in sorted(rows, key=lambda r: r[1]):
        if w0 <= t <= w1:
            n, value = last.get((track, t), (0, None))
            last[track, t] = (n + 1, v if v is not None else value)
    out = []
    for slot in range(lo, hi + 1):
        g = w0 + slot * step
        cells = []
        for track, fine in (("S", lambda v: 0 <= v <= 100), ("R", lambda v: True)):
            seen = [(t, v, n > 1) for (name, t), (n, v) in last.items() if name == track and t <= g and v is not None and fine(v)]
            cells.append(max(seen) if seen else None)
        out.append((slot, *cells))
    return out


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("span", [2, 4096])
def test_dense_case_with_half_of_all_rows(spark, span, threshold):
    """Case 1 holds half of the rows, at sub-second times, most of them within two slots."""
    rng = random.Random(23)
    value = lambda: rng.choice([None, -1.0, 5.0, 50.0, 120.0])
    rows = {1: [(rng.choice("SR"), i, round(rng.choice([rng.uniform(20, 40), rng.uniform(0, 300)]), 3), value()) for i in range(2000)]}
    for case in range(2, 22):
        rows[case] = [(rng.choice("SR"), i, float(rng.randrange(0, 300)), value()) for i in range(100)]
    s = spark.createDataFrame([(c, *r) for c, own in rows.items() for r in own], "caseid bigint, track string, seq bigint, t double, v double").repartition(6)
    cases = spark.createDataFrame([(c, 0.0, 300.0) for c in rows], "caseid bigint, w0 double, w1 double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        looks = (align.Lookup("s", "S", 0, 100), align.Lookup("r", "R"))
        got = align.align_study(s, cases, ("S", "R"), looks, 10.0, before=2, after=1, span=span).where("_home").collect()
        spans = {r.caseid: (r.s0, r.s1) for r in align.common_span(s, cases, ("S", "R")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for case, own in rows.items():
        first = {t: next(r for r in own if r[0] == t)[2] for t in "SR"}
        last = {t: [r for r in own if r[0] == t][-1][2] for t in "SR"}
        assert spans[case] == (max(first.values()), min(last.values()))
        lo, hi = int(np.ceil(spans[case][0] / 10 - 1e-12)), int(np.floor(spans[case][1] / 10 + 1e-12))
        want = plain_asof(own, 0.0, 300.0, 10.0, lo, hi)
        assert [(r.slot, r.s and tuple(r.s), r.r and tuple(r.r)) for r in sorted(got, key=lambda r: r.slot) if r.caseid == case] == want


def test_tree_and_flat_checksums(spark):
    import hashlib

    ids = spark.range(0, 3000).select(F.col("id").alias("n"))
    text = "\n".join(map(str, range(3000))) + "\n"
    assert checksums.flat_checksum(ids, "n").first().sha256 == hashlib.sha256(text.encode()).hexdigest()
    one = checksums.tree_checksum(ids.repartition(7), "n").first()
    two = checksums.tree_checksum(ids.orderBy(F.desc("n")), "n").first()
    assert one == two and one.ids == 3000
    assert checksums.tree_checksum(ids.where("n <> 5"), "n").first().sha256 != one.sha256


@pytest.mark.parametrize("fanout", [4, 1024])
def test_trees_end_by_themselves(spark, fanout):
    import hashlib

    def plain(numbers):
        node = {n: str(n) for n in numbers}
        level = 0
        while level == 0 or list(node) != [0]:
            up = {}
            for n in sorted(node):
                up.setdefault(n // fanout, []).append(n)
            node = {p: node[0] if level and own == [0] else hashlib.sha256(("\n".join(node[n] for n in own) + "\n").encode()).hexdigest() for p, own in up.items()}
            level += 1
        return node[0]

    sets = {"a": [0], "b": list(range(5)), "c": [3, 70, 4000, 10 ** 7], "d": list(range(0, 300, 7)), "e": [10 ** 12]}
    rows = spark.createDataFrame([(k, n) for k, own in sets.items() for n in own], "k string, n bigint").repartition(3)
    got = {r.k: (r.ids, r.sha256) for r in checksums.tree_checksum(rows, "n", keys=["k"], fanout=fanout).collect()}
    assert got == {k: (len(own), plain(own)) for k, own in sets.items()}
    alone = checksums.tree_checksum(rows.where("k = 'b'"), "n", keys=["k"], fanout=fanout).first()
    assert alone.sha256 == got["b"][1]
    text = "".join(f"{n}\n" for n in sorted(sets["c"]))
    assert checksums.flat_checksum(rows.where("k = 'c'"), "n", fanout=fanout).first().sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("width", [5, 63, 64, 200])
def test_disagreement_of_any_width(spark, width):
    from tracksieve.operators import sweep

    rng = np.random.default_rng(width)
    flags = rng.random((90, width)) < rng.random(width)
    flags[40:60] = flags[0]
    names = [f"rule{i}" for i in range(width)]
    wide = spark.createDataFrame([tuple(map(bool, f)) for f in flags], ", ".join(f"{n} boolean" for n in names))
    want = {(a, b): int((flags[:, i] != flags[:, j]).sum()) for i, a in enumerate(names) for j, b in enumerate(names)}
    assert {(r.left, r.right): r.disagreements for r in sweep.disagreement(sweep.pass_masks(wide, names), names).collect()} == want
    long = spark.createDataFrame([(c, n, int(flags[c, i]) * 3) for c in range(90) for i, n in enumerate(names)], "caseid bigint, candidate_id string, usable_windows bigint")
    assert {(r.left, r.right): r.disagreements for r in sweep.disagreement(sweep.candidate_masks(long, names), names).collect()} == want


@pytest.mark.parametrize("rows,cells", [(1, 3), (40, 8), (1000, 4096)])
def test_balanced_segments_follow_the_rows(spark, rows, cells):
    rng = np.random.default_rng(8)
    dense = np.concatenate([1.7e9 + np.arange(1500) * 1e-4, [0.0, 5.0, 2e9], [7.5] * 6])
    t = {1: dense, 2: rng.permutation(300) * 10.0, 3: np.array([4.0])}
    df = spark.createDataFrame([(k, float(x), i) for k, v in t.items() for i, x in enumerate(rng.permutation(v))], "k bigint, o double, n bigint").repartition(4)
    got = od.balanced(df, ["k"], "o", rows, cells).collect()
    assert sorted((r.k, r.n) for r in got) == sorted((r.k, r.n) for r in df.collect())
    for k in t:
        mine = sorted((r.o, r[od.SEG]) for r in got if r.k == k)
        assert [s for _, s in mine] == sorted(s for _, s in mine)
        sizes = {s: [o for o, x in mine if x == s] for s in {s for _, s in mine}}
        assert all(len(v) <= 2 * rows or len(set(v)) == 1 for v in sizes.values())
        assert all(sum(1 for o, _ in mine if o < min(v)) == s for s, v in sizes.items())


def test_asof_at_any_points_of_a_dense_hot_key(spark):
    rng = np.random.default_rng(12)
    obs = {1: np.unique(np.round(50 + rng.random(1500) * 0.2, 4)), 2: np.arange(0.0, 200.0, 3.0)}
    points = {1: np.concatenate([50 + rng.random(400) * 0.2, [0.0, 99.0]]), 2: rng.random(50) * 220 - 10}
    o = spark.createDataFrame([(k, float(t), float(i)) for k, v in obs.items() for i, t in enumerate(v)], "k bigint, t double, v double")
    p = spark.createDataFrame([(k, float(g)) for k, v in points.items() for g in v], "k bigint, g double")
    got = {(r.k, r.g): r.obs and (r.obs.t, r.obs.v) for r in align.align_points(o, p, ["k"], rows=30).collect()}
    for k, v in points.items():
        for g in v:
            i = int(np.searchsorted(obs[k], g, side="right")) - 1
            assert got[k, float(g)] == ((obs[k][i], float(i)) if i >= 0 else None)
