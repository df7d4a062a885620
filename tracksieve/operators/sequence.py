"""Descriptive statistics of recorded rows: no sorting by time, no deduplication.

Rows are taken in recorded order (``seq``) per (case, track).  All results are
sums, extremes and islands over bounded segments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksieve.functions.columns import finite, is_finite
from tracksieve.functions.quantiles import COUNT, RECORD_QUANTILES, exact_quantiles, quantiles_of_counts, value_counts
from tracksieve.operators.ordered import SEG, SPAN, attach, islands, previous_row, segmented

KEYS = ("caseid", "track")

# Gap thresholds, fixed run boundaries (seconds), adaptive multiplier.
GAP_THRESHOLDS = (10, 30, 60, 120, 300, 600)
RUN_BOUNDARIES = (30, 60, 120, 300)
GAP_MULTIPLIER = 3.0


def rows_of(signal: DataFrame, cases: DataFrame, span: int = SPAN) -> DataFrame:
    """Recorded rows with their case window, the finite value ``x`` and the position
    (before / inside / after; an inverted window has nothing inside)."""
    r = attach(segmented(signal, "seq", span), cases, ["caseid"], KEYS)
    t = F.col("t")
    position = F.when(t < F.col("w0"), "before").when(t > F.col("w1"), "after").otherwise("inside")
    return r.withColumn("x", finite("v")).withColumn("position", position).withColumn("valid_window", F.col("w1") >= F.col("w0"))


def inside(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("t").between(F.col("w0"), F.col("w1")))


def with_previous(rows: DataFrame) -> DataFrame:
    """Add ``prev`` (t, x) in recorded order and ``delta`` seconds since it."""
    return previous_row(rows, KEYS, "seq", ["t", "x"]).withColumn("delta", F.col("t") - F.col("prev.t"))


def interval_stats(rows_with_prev: DataFrame, thresholds: Sequence[float] = GAP_THRESHOLDS) -> DataFrame:
    """Per track: duplicate timestamps, zero / negative / positive steps, positive-step quantiles and gap counts.

    Steps are counted by value in one pass; everything else reads those counts.
    """
    keys, d, c = list(KEYS), F.col("delta"), F.col(COUNT)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, c)), F.lit(0))

    r = rows_with_prev.select(*keys, "delta", F.when(F.col("delta") > 0, F.col("delta")).alias("_pos"))
    counts = r.groupBy(*keys, "delta", "_pos").agg(F.count(F.lit(1)).alias(COUNT))
    wanted = {**{f"q{n}": (p, "nearest") for n, p in (("05", .05), ("25", .25), ("75", .75), ("95", .95))}, "median": (.5, "linear")}
    steps = quantiles_of_counts(counts, keys, "_pos", wanted, extra=[
        F.sum(c).alias("rows"), total(d == 0).alias("zero_intervals"), total(d < 0).alias("negative_intervals"),
        F.min("_pos").alias("minimum"), F.max("_pos").alias("longest_gap"),
        *[total(d > s).alias(f"gap_gt_{s}") for s in thresholds]])
    times = rows_with_prev.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum(F.col("_c") - 1).alias("duplicate_timestamps"))
    return steps.withColumnRenamed("n", "positive_intervals").join(times, keys)


def window_position(rows: DataFrame) -> DataFrame:
    """Rows before / inside / after, first and last in recorded order, observed span and its share (null for a window without length)."""
    keys = list(KEYS)
    inn = F.when(F.col("position") == "inside", F.col("seq"))
    out = rows.groupBy(*keys).agg(
        F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("position") == p).alias(f"rows_{p}") for p in ("before", "inside", "after")],
        F.min_by("t", "seq").alias("first_t"), F.max_by("t", "seq").alias("last_t"),
        F.min_by("t", inn).alias("first_inside"), F.max_by("t", inn).alias("last_inside"))
    span = F.when(F.col("first_inside").isNotNull(), F.greatest(F.lit(0.0), F.col("last_inside") - F.col("first_inside")))
    return out.withColumn("observed_span", span).withColumn(
        "span_ratio", F.try_divide("observed_span", F.col("w1") - F.col("w0"))).drop("w0", "w1")


def value_stats(rows_with_prev: DataFrame) -> DataFrame:
    """Finite / non-finite / missing counts, extremes, quantiles, distinct values and value changes."""
    keys, x, v, c = list(KEYS), F.col("x"), F.col("v"), F.col(COUNT)
    bad = v.isNotNull() & ~is_finite(v)
    counts = value_counts(rows_with_prev, keys, "x", _changes=(x != F.col("prev.x")).cast("bigint"), _bad=bad.cast("bigint"))
    zero = F.lit(0)
    return quantiles_of_counts(counts, keys, "x", {n: (p, "nearest") for n, p in RECORD_QUANTILES.items()}, extra=[
        (F.coalesce(F.sum(F.when(x.isNull(), c - F.col("_bad"))), zero)).alias("missing"), F.coalesce(F.sum("_bad"), zero).alias("nonfinite"),
        F.min("x").alias("minimum"), F.max("x").alias("maximum"),
        F.coalesce(F.sum("_changes"), zero).alias("value_changes"), F.count("x").alias("unique_values"),
    ]).withColumnRenamed("n", "finite")


def longest_constant_run(rows_with_prev: DataFrame) -> DataFrame:
    """Longest run of equal consecutive finite values, in samples; a missing value ends a run."""
    r = rows_with_prev.where(F.col("x").isNotNull())
    start = F.coalesce(F.col("x") != F.col("prev.x"), F.lit(True))
    runs = islands(r, KEYS, "seq", start, sums={"samples": F.lit(1)})
    return runs.groupBy(*KEYS).agg(F.max("samples").alias("longest_samples"), F.count(F.lit(1)).alias("runs"))


def bounded_runs(
    rows_with_prev: DataFrame, predicates: Mapping[str, Callable[[Column], Column]], bounds: Mapping[str, Column],
) -> DataFrame:
    """Gap-bounded runs per (case, track, predicate, boundary): count, longest and total seconds.

    A matching row continues a run when the row before matched too and
    0 < delta <= boundary; a null boundary never continues.  The predicates
    exclude one another; a boundary is constant within a track.  A run of one
    row lasts 0 seconds.

    Rows are first merged under the smallest boundary, so only the pieces, and
    not the rows, are repeated per boundary.
    """

    def label(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, match in predicates.items():
            out = F.when(match(c), name).otherwise(out)
        return out

    names = [f"_b{i}" for i in range(len(bounds))]
    r = rows_with_prev.select(
        *KEYS, SEG, "seq", "delta", label(F.col("x")).alias("predicate"), label(F.col("prev.x")).alias("_before"),
        *[b.cast("double").alias(n) for n, b in zip(names, bounds.values())]).where(F.col("predicate").isNotNull())
    # The step that could join this row to the run before; null where nothing can.
    r = r.withColumn("_link", F.when((F.col("_before") == F.col("predicate")) & (F.col("delta") > 0), F.col("delta")))
    smallest = F.when(~F.exists(F.array(*names), lambda b: b.isNull()), F.array_min(F.array(*names)))
    tight = F.coalesce(F.col("_link") <= smallest, F.lit(False))
    pieces = islands(
        r, [*KEYS, "predicate"], "seq", ~tight,
        sums={"seconds": F.when(tight, F.col("_link")).otherwise(0.0)},
        mins={"_head": F.struct("seq", "_link")}, maxs={n: F.col(n) for n in names})
    each = pieces.select(
        *KEYS, "predicate", "seconds", F.col("_head.seq").alias("seq"), F.col("_head._link").alias("_link"),
        F.explode(F.array(*[F.struct(F.lit(b).alias("boundary"), F.col(n).alias("bound")) for b, n in zip(bounds, names)])).alias("_e"),
    ).select("*", "_e.*").drop("_e")
    joined = F.coalesce(F.col("_link") <= F.col("bound"), F.lit(False))
    runs = islands(segmented(each, "seq"), [*KEYS, "predicate", "boundary"], "seq", ~joined, sums={
        "seconds": F.col("seconds") + F.when(joined, F.col("_link")).otherwise(0.0)})
    return runs.groupBy(*KEYS, "predicate", "boundary").agg(
        F.count(F.lit(1)).alias("runs"), F.max("seconds").alias("longest_seconds"), F.sum("seconds").alias("total_seconds"))


POSITIVE = {"positive": lambda x: x > 0}
POSITIVE_AND_ZERO = {"positive": lambda x: x > 0, "zero": lambda x: x == 0}


def median_step(rows_with_prev: DataFrame) -> DataFrame:
    """Median positive step per track (interpolated); null where no step is positive."""
    r = rows_with_prev.select(*KEYS, F.when(F.col("delta") > 0, F.col("delta")).alias("_pos"))
    return exact_quantiles(r, KEYS, "_pos", {"median_step": .5}, method="linear").drop("n")


def with_adaptive_bound(rows_with_prev: DataFrame, multiplier: float = GAP_MULTIPLIER) -> DataFrame:
    """Add ``median_step`` and ``adaptive_bound`` = multiplier x median positive step of the track."""
    m = median_step(rows_with_prev).withColumn("adaptive_bound", F.col("median_step") * multiplier)
    return attach(rows_with_prev, m, KEYS, KEYS, "left")


def fixed_and_adaptive_bounds(fixed: Sequence[float] = RUN_BOUNDARIES) -> dict[str, Column]:
    return {"adaptive": F.col("adaptive_bound"), **{f"fixed_{s}": F.lit(float(s)) for s in fixed}}


# Warning flags of a track record, in sorted order.
EVIDENCE_FLAGS = (
    "continuity_boundary_unavailable", "duplicate_timestamp", "inverted_window", "long_gap",
    "negative_interval", "nonfinite_value", "zero_interval",
)


def track_cadence(signal: DataFrame, cases: DataFrame, span: int = SPAN, multiplier: float = GAP_MULTIPLIER) -> DataFrame:
    """(caseid, track, median_step, gap_bound) of every present track: the two measures of ``track_evidence`` alone, without its runs and counts."""
    rows = rows_of(signal, cases, span)
    steps = median_step(with_previous(inside(rows)))
    return rows.select(*KEYS).distinct().join(steps, list(KEYS), "left").withColumn("gap_bound", F.col("median_step") * multiplier)


def track_evidence(signal: DataFrame, cases: DataFrame, span: int = SPAN) -> DataFrame:
    """Cadence-adaptive positive-run evidence: one row per present (case, track), warnings as a sorted array."""
    keys = list(KEYS)
    rows = rows_of(signal, cases, span)
    x = F.col("x")
    whole = rows.groupBy(*keys).agg(
        (F.count_if(x > 0) > 0).alias("positive_anywhere"),
        F.count_if(F.col("v").isNotNull() & ~is_finite("v")).alias("nonfinite_values"),
        F.first("valid_window").alias("valid_window"))
    win = with_adaptive_bound(with_previous(inside(rows)))
    d = F.col("delta")
    counts = win.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count("x").alias("finite"), F.count_if(x > 0).alias("positive"),
        F.first("median_step").alias("median_step"), F.first("adaptive_bound").alias("gap_bound"),
        F.count_if(d == 0).alias("zero_intervals"), F.count_if(d < 0).alias("negative_intervals"),
        F.count_if(d > F.col("adaptive_bound")).alias("long_gaps"))
    dup = win.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum(F.col("_c") - 1).alias("duplicate_timestamps"))
    runs = bounded_runs(win, POSITIVE, {"adaptive": F.col("adaptive_bound")}).drop("predicate", "boundary")
    zeros = ["samples", "finite", "positive", "zero_intervals", "negative_intervals", "long_gaps",
             "duplicate_timestamps", "runs", "longest_seconds", "total_seconds"]
    e = (
        whole.join(counts, keys, "left").join(dup, keys, "left").join(runs, keys, "left").fillna(0, zeros)
        .withColumn("positive_proportion", F.when(F.col("finite") > 0, F.col("positive") / F.col("finite")))
    )
    flags = {
        "continuity_boundary_unavailable": (F.col("positive") > 0) & F.col("gap_bound").isNull(),
        "duplicate_timestamp": F.col("duplicate_timestamps") > 0, "inverted_window": ~F.col("valid_window"),
        "long_gap": F.col("long_gaps") > 0, "negative_interval": F.col("negative_intervals") > 0,
        "nonfinite_value": F.col("nonfinite_values") > 0, "zero_interval": F.col("zero_intervals") > 0,
    }
    return e.withColumn("flags", F.array_compact(F.array(*[F.when(flags[f], F.lit(f)) for f in EVIDENCE_FLAGS])))


def complete_evidence(evidence: DataFrame, cases: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """Every expected (case, track) once; absent tracks carry zero counts and null measures."""
    names = F.array(*[F.lit(t) for t in tracks])
    expected = cases.select("caseid", F.explode(names).alias("track"), (F.col("w1") >= F.col("w0")).alias("_vw"))
    out = expected.join(evidence.withColumn("present", F.lit(True)), list(KEYS), "left")
    counts = [c for c, t in evidence.dtypes if t in ("bigint", "double") and c not in ("caseid", "median_step", "gap_bound", "positive_proportion")]
    return (
        out.fillna(0, counts).fillna(False, ["present", "positive_anywhere"])
        .withColumn("valid_window", F.coalesce("valid_window", "_vw")).drop("_vw")
        .withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    )


def naive_runs(rows: DataFrame) -> DataFrame:
    """Runs of consecutive positive rows without a gap rule: length is last minus first, not below 0."""
    r = previous_row(rows, KEYS, "seq", ["x"])
    r = r.where(F.col("x") > 0).withColumn("_start", ~F.coalesce(F.col("prev.x") > 0, F.lit(False)))
    runs = islands(r, KEYS, "seq", F.col("_start"), mins={"_a": F.struct("seq", "t")}, maxs={"_z": F.struct("seq", "t")})
    length = F.greatest(F.lit(0.0), F.col("_z.t") - F.col("_a.t"))
    return runs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("runs"), F.max(length).alias("longest_seconds"))


def range_shares(rows: DataFrame) -> DataFrame:
    """Counts, shares and first/last recorded time of the value ranges of a 0-100 signal."""
    x, seq = F.col("x"), F.col("seq")
    full, narrow = x.between(0, 100), x.between(10, 100)
    out = rows.groupBy(*KEYS).agg(
        F.count("x").alias("finite"), F.count_if(x == 0).alias("equal_zero"), F.count_if(x < 0).alias("negative"),
        F.count_if((x >= 0) & (x < 10)).alias("from_0_below_10"), F.count_if(narrow).alias("from_10_to_100"),
        F.count_if(x > 100).alias("above_100"), F.count_if(full).alias("from_0_to_100"),
        *[agg(F.col("t"), F.when(cond, seq)).alias(f"{which}_{name}")
          for name, cond in (("finite", x.isNotNull()), ("0_100", full), ("10_100", narrow))
          for which, agg in (("first", F.min_by), ("last", F.max_by))])
    n = F.nullif(F.col("finite"), F.lit(0))
    return out.withColumn("share_0_100", F.col("from_0_to_100") / n).withColumn("share_10_100", F.col("from_10_to_100") / n)


def quality_shares(rows: DataFrame, thresholds: Sequence[int] = (20, 50, 80)) -> DataFrame:
    x = F.col("x")
    out = rows.groupBy(*KEYS).agg(
        F.count("x").alias("finite"), F.count_if(x < 0).alias("negative"), F.count_if(x > 100).alias("above_100"),
        *[F.count_if(x >= q).alias(f"ge_{q}") for q in thresholds])
    for q in thresholds:
        out = out.withColumn(f"share_ge_{q}", F.col(f"ge_{q}") / F.nullif(F.col("finite"), F.lit(0)))
    return out


def rate_block(rows: DataFrame) -> DataFrame:
    x, seq = F.col("x"), F.col("seq")
    out = rows.groupBy(*KEYS).agg(
        F.count("x").alias("finite"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"),
        F.count_if(x > 0).alias("positive"),
        *[agg(F.col("t"), F.when(cond, seq)).alias(f"{which}_{name}")
          for name, cond in (("finite", x.isNotNull()), ("positive", x > 0))
          for which, agg in (("first", F.min_by), ("last", F.max_by))])
    return out.withColumn("share_positive", F.col("positive") / F.nullif(F.col("finite"), F.lit(0)))


def parse_warnings(rows_with_prev: DataFrame) -> DataFrame:
    """Sorted warning set of a whole track file."""
    x = F.col("x")
    one = rows_with_prev.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("samples"), F.count("x").alias("finite"),
        (F.count_if(x < 0) > 0).alias("negative_value"),
        (F.count_if(F.col("delta") < 0) > 0).alias("nonmonotonic_timestamp"),
        (F.count_if(F.col("v").isNotNull() & x.isNull()) > 0).alias("nonfinite_value"))
    dup = rows_with_prev.groupBy(*KEYS, "t").agg(F.count(F.lit(1)).alias("_c")).groupBy(*KEYS).agg(
        (F.max("_c") > 1).alias("duplicate_timestamp"))
    names = ("duplicate_timestamp", "negative_value", "nonfinite_value", "nonmonotonic_timestamp")
    return one.join(dup, list(KEYS)).select(*KEYS, "samples", "finite", F.array_compact(
        F.array(*[F.when(F.col(n), F.lit(n)) for n in names])).alias("warnings"))


def case_rollup(evidence: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per case: positive flags, longest run and largest positive share, over all tracks and per track group."""
    def both(cond: Column | None, suffix: str) -> list[Column]:
        pick = (lambda c: c) if cond is None else (lambda c: F.when(cond, c))
        zero = F.lit(0.0)
        return [
            F.coalesce(F.max(pick(F.col("positive") > 0)), F.lit(False)).alias(f"positive_{suffix}"),
            F.coalesce(F.max(pick(F.col("longest_seconds"))), zero).alias(f"longest_{suffix}"),
            F.coalesce(F.max(pick(F.col("positive_proportion"))), zero).alias(f"proportion_{suffix}")]

    aggs = both(None, "any")
    for name, members in groups.items():
        aggs += both(F.col("track").isin(*members), name)
    return evidence.groupBy("caseid").agg(
        *aggs, F.max("positive_anywhere").alias("positive_anywhere"), F.max("valid_window").alias("valid_window"),
        *[F.sum(c).alias(c) for c in ("duplicate_timestamps", "zero_intervals", "negative_intervals", "long_gaps")],
        F.count_if(F.size("flags") > 0).alias("warning_tracks"))


def case_status(track_manifest: DataFrame) -> DataFrame:
    """Per case roll-up of (present, status, positive, negative, finite, window_positive, warnings) track rows."""
    s = F.col("status")
    p = F.col("present")
    ok = s.isin("complete", "empty_signal")
    out = track_manifest.groupBy("caseid").agg(
        F.count_if(p).alias("present_tracks"), F.count_if(~p).alias("absent_tracks"),
        F.count_if(s == "complete").alias("complete_tracks"), F.count_if(p & (s == "empty_signal")).alias("empty_tracks"),
        F.count_if(p & ~ok).alias("failed_tracks"),
        F.max(F.coalesce(F.col("positive") > 0, F.lit(False))).alias("positive_anywhere"),
        F.max(F.coalesce(F.col("window_positive") > 0, F.lit(False))).alias("positive_inside"),
        F.count_if(p & (s == "complete") & (F.col("finite") > 0) & (F.col("positive") == 0) & (F.col("negative") == 0)).alias("all_zero_tracks"),
        F.count_if(F.size("warnings") > 0).alias("warning_tracks"))
    return out.withColumn("case_status", F.when(F.col("failed_tracks") > 0, "failed")
                          .when(F.col("present_tracks") == 0, "complete_no_allowed_tracks_present")
                          .when(F.col("empty_tracks") > 0, "complete_with_empty_signal").otherwise("complete"))


#: The statuses of a (case, track) row.
TRACK_STATUS = ("complete", "empty_signal", "failed", "track_absent")


def track_summary(track_manifest: DataFrame, statuses: Sequence[str] = TRACK_STATUS) -> DataFrame:
    """Per track roll-up of the rows that ``case_status`` takes: cases by status, all-zero, positive, positive inside the window, with a warning."""
    s, p = F.col("status"), F.col("present")
    return track_manifest.groupBy("track").agg(
        F.count(F.lit(1)).alias("expected_cases"), F.count_if(p).alias("present_cases"), *[F.count_if(s == x).alias(x) for x in statuses],
        F.count_if(p & (s == "complete") & (F.col("finite") > 0) & (F.col("positive") == 0) & (F.col("negative") == 0)).alias("all_zero_cases"),
        F.count_if(F.col("positive") > 0).alias("positive_cases"), F.count_if(F.col("window_positive") > 0).alias("window_positive_cases"),
        F.count_if(F.size("warnings") > 0).alias("warning_cases"))
