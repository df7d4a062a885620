"""Deduplication, fixed grids and causal as-of alignment of several tracks.

The grid as-of scans the recorded rows once.  They are combined before every
shuffle: to one row per timestamp (last finite values, duplicates, exact-time
quality), then to one row per grid slot with the latest accepted row of every
lookup.  Grid segments hold slots, so their size is bounded by the grid however
dense the recording is, and no case, segment or second is a hot key.  Values are
carried forward inside segments and over their borders by one row per segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.functions.columns import is_finite
from tracksieve.operators.ordered import SEG, SPAN, balanced, dense_rows, last_known, segment_of, spread_join, tasks_for
from tracksieve.session import cut_lineage, shuffled_into

GRID_SPAN = 4096
EPS_GRID = 1e-12
EPS_AGE = 1e-9


@dataclass(frozen=True)
class Lookup:
    """One causal lookup: which track, which values are accepted, which quality is required.

    A value outside [low, high] is skipped, so an older accepted one is used.
    Leave both open for a blocking lookup, where the latest value always decides.
    """

    name: str
    track: str
    low: float | None = None
    high: float | None = None
    quality_track: str | None = None
    quality_min: float | None = None


def in_window(signal: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows inside their case window."""
    return spread_join(signal, cases, ["caseid"], "seq").where(F.col("t").between(F.col("w0"), F.col("w1")))


def dedupe_last_finite(signal: DataFrame, cases: DataFrame) -> DataFrame:
    """(caseid, track, t, v, dup): last finite row per timestamp in recorded order.

    ``dup`` counts every row at the timestamp, finite or not.
    """
    return (
        in_window(signal, cases).groupBy("caseid", "track", "t")
        .agg(F.max(F.when(is_finite("v"), F.struct("seq", "v"))).alias("_l"), (F.count(F.lit(1)) > 1).alias("dup"))
        .where(F.col("_l").isNotNull())
        .select("caseid", "track", "t", F.col("_l.v").alias("v"), "dup")
    )


def index_counters(signal_with_prev: DataFrame, cases: DataFrame) -> DataFrame:
    """Per track: rows, zero and negative steps (whole file), finite rows and duplicates (window)."""
    d = F.col("t") - F.col("prev.t")
    inside = F.col("t").between(F.col("w0"), F.col("w1"))
    whole = signal_with_prev.groupBy("caseid", "track").agg(
        F.count(F.lit(1)).alias("original_row_count"),
        F.count_if(d == 0).alias("zero_interval_count"), F.count_if(d < 0).alias("negative_interval_count"))
    at = (
        spread_join(signal_with_prev, cases, ["caseid"], "seq").where(inside).groupBy("caseid", "track", "t")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_finite("v")).alias("_f"))
        .groupBy("caseid", "track")
        .agg(F.sum("_f").alias("finite_row_count"), F.sum(F.col("_n") - 1).alias("duplicate_timestamp_count"))
    )
    zero = F.lit(0)
    return whole.join(at, ["caseid", "track"], "left").select(
        "caseid", "track", "original_row_count", F.coalesce("finite_row_count", zero).alias("finite_row_count"),
        F.coalesce("duplicate_timestamp_count", zero).alias("duplicate_timestamp_count"),
        "zero_interval_count", "negative_interval_count")


def common_span(signal: DataFrame, cases: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """(caseid, w0, w1, s0, s1, limiting): span all tracks share, by recorded first and last row.

    Tracks without a row inside the window leave the span null and are named as limiting.
    """
    aggs = []
    for i, name in enumerate(tracks):
        own = F.when(F.col("track") == name, F.col("seq"))
        aggs += [F.min_by("t", own).alias(f"_f{i}"), F.max_by("t", own).alias(f"_l{i}")]
    rows = in_window(signal.where(F.col("track").isin(*tracks)), cases)
    return _spans(rows.groupBy("caseid").agg(*aggs), cases, tracks)


def _spans(per: DataFrame, cases: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """The common span from each track's first and last time, ``_f<i>`` and ``_l<i>``."""
    all_there = F.lit(True)
    for i in range(len(tracks)):
        all_there = all_there & F.col(f"_f{i}").isNotNull()
    s0 = F.when(all_there, F.greatest(*[F.col(f"_f{i}") for i in range(len(tracks))]))
    s1 = F.when(all_there, F.least(*[F.col(f"_l{i}") for i in range(len(tracks))]))
    limiting = F.array_sort(F.array_compact(F.array(*[
        F.when(F.when(all_there, (F.col(f"_f{i}") == F.col("s0")) | (F.col(f"_l{i}") == F.col("s1")))
               .otherwise(F.col(f"_f{i}").isNull()), F.lit(name)) for i, name in enumerate(tracks)])))
    out = cases.join(per, "caseid", "left").withColumn("s0", s0).withColumn("s1", s1)
    return out.select("caseid", "w0", "w1", "s0", "s1", limiting.alias("limiting"))


def grid_bounds(spans: DataFrame, step: float) -> DataFrame:
    """First and last grid step (``lo``..``hi``) anchored at the window start; empty grids drop out."""
    lower, upper = F.greatest("w0", "s0"), F.least("w1", "s1")
    return (
        spans.where((F.col("s1") >= F.col("s0")) & (upper >= lower))
        .withColumn("lo", F.ceil((lower - F.col("w0")) / step - EPS_GRID))
        .withColumn("hi", F.floor((upper - F.col("w0")) / step + EPS_GRID))
        .where(F.col("hi") >= F.col("lo"))
        .select("caseid", "w0", "w1", F.col("lo").cast("bigint"), F.col("hi").cast("bigint"))
    )


def grid_points(bounds: DataFrame, step: float) -> DataFrame:
    """(caseid, slot, g, k, n): one row per grid point; k counts from 0, n points in all."""
    return dense_rows(bounds, "caseid", F.col("lo"), F.col("hi"), "slot", GRID_SPAN).withColumn(
        "n", F.col("hi") - F.col("lo") + 1).select("caseid", "slot", (F.col("w0") + F.col("slot") * F.lit(step)).alias("g"),
             (F.col("slot") - F.col("lo")).alias("k"), "n")


def slot_of(t: Column, anchor: Column, step: float) -> Column:
    """The first slot whose grid time is at or after ``t``, exact on the computed grid times."""
    s = F.ceil((t - anchor) / step).cast("bigint")
    up = F.when(anchor + s * F.lit(step) < t, s + 1).otherwise(s)
    return F.when(anchor + (up - 1) * F.lit(step) >= t, up - 1).otherwise(up)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def slot_table(signal: DataFrame, windows: DataFrame, lookups: Sequence[Lookup], step: float, spans: Sequence[str] = ()) -> DataFrame:
    """(caseid, slot, <lookup>..., _f<i>, _fs<i>, _l<i>, _ls<i>): one row per case and grid slot with rows in the window.

    Each lookup is a struct (t, v, dup[, q]) of its latest accepted timestamp in the slot.  For
    every track of ``spans``, _f/_l are the times of its first and last recorded row, _fs/_ls
    their places in the recording.  All aggregates combine before they are shuffled.
    """
    valued = sorted({x.track for x in lookups} | {x.quality_track for x in lookups if x.quality_track})
    rows = in_window(signal.where(F.col("track").isin(*{*valued, *spans})), windows).select(
        "caseid", slot_of(F.col("t"), F.col("w0"), step).alias("slot"), "track", "seq", "t", "v")
    at = {name: i for i, name in enumerate(valued)}
    # Text expressions: one call each instead of one for every operator inside.
    finite = "v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')"
    per_t = [a for name, i in at.items() for a in (
        f"max_by(v, CASE WHEN track = {_quoted(name)} AND {finite} THEN seq END) AS _v{i}", f"count_if(track = {_quoted(name)}) > 1 AS _d{i}")]
    per_t += [f"{f}(CASE WHEN track = {_quoted(name)} THEN seq END) AS _{p}s{i}" for i, name in enumerate(spans) for p, f in (("f", "min"), ("l", "max"))]
    per_slot, entries = [], []
    for x in lookups:
        v, dup, q = f"_v{at[x.track]}", f"_d{at[x.track]}", None
        ok = [f"{v} IS NOT NULL"] + [f"{v} {op} {float(bound)!r}D" for op, bound in ((">=", x.low), ("<=", x.high)) if bound is not None]
        if x.quality_track:
            q = f"_v{at[x.quality_track]}"
        if x.quality_min is not None:
            ok, dup = [*ok, f"coalesce({q} >= {float(x.quality_min)!r}D, false)"], f"({dup} OR _d{at[x.quality_track]})"
        t = f"CASE WHEN {' AND '.join(ok)} THEN t END"
        fields = {"t": f"max({t})", "v": f"max_by({v}, {t})", "dup": f"max_by({dup}, {t})"} | ({"q": f"max_by({q}, {t})"} if q else {})
        per_slot += [f"{c} AS _{x.name}_{f}" for f, c in fields.items()]
        entries.append(f"CASE WHEN _{x.name}_t IS NOT NULL THEN named_struct({', '.join(f"'{f}', _{x.name}_{f}" for f in fields)}) END AS {x.name}")
    for i in range(len(spans)):
        per_slot += [f"min_by(t, _fs{i}) AS _f{i}", f"min(_fs{i}) AS _fs{i}", f"max_by(t, _ls{i}) AS _l{i}", f"max(_ls{i}) AS _ls{i}"]
    slots = rows.groupBy("caseid", "slot", "t").agg(*map(F.expr, per_t)).groupBy("caseid", "slot").agg(*map(F.expr, per_slot))
    return slots.selectExpr("caseid", "slot", *entries, *[f"_{p}{i}" for i in range(len(spans)) for p in ("f", "fs", "l", "ls")])


def align_study(
    signal: DataFrame, cases: DataFrame, primary: Sequence[str], lookups: Sequence[Lookup], step: float, *,
    before: int = 0, after: int = 0, span: int = GRID_SPAN,
) -> DataFrame:
    """``align_grid`` on the grid of the primary tracks' common span; the recorded rows are scanned once for both."""
    cases = cut_lineage(cases)  # known in size before the setting below: it is an aggregate of the signal itself in some studies
    with shuffled_into(signal.sparkSession, tasks_for(signal, signal.count())):
        table = cut_lineage(slot_table(signal, cases, lookups, step, primary))
    per = table.groupBy("caseid").agg(*[a for i in range(len(primary)) for a in (
        F.min_by(f"_f{i}", f"_fs{i}").alias(f"_f{i}"), F.max_by(f"_l{i}", f"_ls{i}").alias(f"_l{i}"))])
    bounds = grid_bounds(_spans(per, cases, primary), step)
    return _fill(table.select("caseid", "slot", *[x.name for x in lookups]), bounds, [x.name for x in lookups], step, before, after, span, table.count())


def align_grid(
    signal: DataFrame, bounds: DataFrame, lookups: Sequence[Lookup], step: float, *,
    before: int = 0, after: int = 0, span: int = GRID_SPAN,
) -> DataFrame:
    """Grid points with one struct (t, v, dup[, q]) per lookup: the latest accepted row at or before g.

    Output (caseid, slot, g, k, n, <lookup>..., _seg, _home), partitioned by
    (caseid, _seg).  ``before``/``after`` keep that many neighbouring points of
    the next segments (``_home`` false) for row frames over ``point_window()``.
    """
    table = slot_table(signal, bounds, lookups, step)
    return _fill(table, bounds, [x.name for x in lookups], step, before, after, span)


def _fill(slots: DataFrame, bounds: DataFrame, names: Sequence[str], step: float, before: int, after: int, span: int, recorded: int = 0) -> DataFrame:
    """Grid points of ``bounds`` with the latest entry of ``slots`` (``recorded`` rows, where known) at or before each, per name."""
    bounds = cut_lineage(bounds)
    points = bounds.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    rows = slots.withColumn(SEG, F.explode(F.sequence(segment_of(F.col("slot") - after, span), segment_of(F.col("slot") + before, span))))
    segs = bounds.withColumn(SEG, F.explode(F.sequence(segment_of(F.col("lo") - after, span), segment_of(F.col("hi") + before, span))))
    # A segment travels as one mark and becomes its grid points only after the shuffle.
    first, last = F.greatest(F.col("lo"), F.col(SEG) * span - before), F.least(F.col("hi"), F.col(SEG) * span + (span - 1 + after))
    marks = segs.select("caseid", SEG, "w0", "lo", "hi", first.alias("_a"), last.alias("_b"))
    each = F.when(F.col("_a").isNotNull(), F.sequence(F.col("_a"), F.col("_b"))).otherwise(F.array("slot"))
    facts = ("w0", "lo", "hi")
    placed = (
        rows.unionByName(marks, allowMissingColumns=True).repartition(tasks_for(bounds, points + recorded), "caseid", SEG)
        .select("caseid", SEG, F.explode(each).alias("slot"), *names, *facts))
    held = placed.groupBy("caseid", SEG, "slot").agg(*[F.expr(f"max({c}) AS {c}") for c in (*names, *facts)])
    # Carry over segment borders.  The points a segment borrows from the one before
    # must not see that segment's last `before` slots, which they already hold.
    home = f"{SEG} = floor(slot / {span})"
    early = f"{home} AND slot < ({SEG} + 1) * {span} - {before}"
    edges = held.groupBy("caseid", SEG).agg(*[
        F.expr(f"max(CASE WHEN {on} THEN {x} END) AS _{p}_{x}") for x in names for p, on in (("all", home), ("early", early))])
    older = f"OVER (PARTITION BY caseid ORDER BY {SEG} RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"
    just = f"OVER (PARTITION BY caseid ORDER BY {SEG} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    carry = edges.selectExpr("caseid", SEG, *[f"greatest(max(_all_{x}) {older}, max(_early_{x}) {just}) AS _in_{x}" for x in names])
    local = f"OVER (PARTITION BY caseid, {SEG} ORDER BY slot ROWS UNBOUNDED PRECEDING)"
    filled = held.selectExpr("caseid", SEG, "slot", *facts, *[f"last({x}, true) {local} AS {x}" for x in names]).where("lo IS NOT NULL")
    return filled.join(carry, ["caseid", SEG], "left").selectExpr(
        "caseid", SEG, "slot", f"w0 + slot * {float(step)!r}D AS g", "slot - lo AS k", "hi - lo + 1 AS n", f"{home} AS _home",
        *[f"coalesce({x}, _in_{x}) AS {x}" for x in names])


def point_window(first: int, last: int):
    """Row frame over neighbouring grid points of an aligned grid."""
    return Window.partitionBy("caseid", SEG).orderBy("slot").rowsBetween(first, last)


def age(lookup: str) -> Column:
    return F.col("g") - F.col(f"{lookup}.t")


def capped(lookup: str, cap: float | Column) -> Column:
    """True where the lookup is present and no older than ``cap``."""
    return F.coalesce(age(lookup) <= cap + EPS_AGE, F.lit(False))


def blocking_state(lookup: str, cap: float | Column) -> Column:
    """0 unavailable, 1 zero, 2 positive, 3/4 the same from a duplicated timestamp.

    A negative latest value blocks; it never falls back to an older one.
    """
    v, dup = F.col(f"{lookup}.v"), F.col(f"{lookup}.dup")
    return (
        F.when(v.isNull() | (v < 0) | ~capped(lookup, cap), 0)
        .when(v > 0, F.when(dup, 4).otherwise(2))
        .otherwise(F.when(dup, 3).otherwise(1))
    )


def blocking_reason(lookup: str, cap: float | Column) -> Column:
    v = F.col(f"{lookup}.v")
    return (
        F.when(v.isNull(), "unavailable_no_prior_finite_observation")
        .when(v < 0, "unavailable_latest_finite_negative")
        .when(~capped(lookup, cap), "unavailable_hold_cap_exceeded")
        .when(v > 0, "usable_positive").otherwise("usable_zero")
    )


def usable_windows(aligned: DataFrame, signal: Column, rates: Sequence[Column], history: int, target: int) -> DataFrame:
    """Per case: endpoints whose last ``history`` points are all usable and whose point ``target`` ahead is.

    ``signal`` and ``rates`` are booleans of the aligned grid (built with
    before=history-1, after=target).
    """
    back = point_window(-(history - 1), 0)
    ready = F.min(signal).over(back)
    for r in rates:
        ready = ready & F.min(r).over(back)
    ahead = F.lead(signal, target).over(Window.partitionBy("caseid", SEG).orderBy("slot"))
    flagged = aligned.select("caseid", "k", "n", "_home", ready.alias("_ready"), ahead.alias("_ahead"))
    endpoint = (F.col("k") >= history - 1) & (F.col("k") < F.col("n") - target)
    return flagged.where(F.col("_home")).groupBy("caseid").agg(
        F.first("n").alias("grid_points"), F.count_if(endpoint).alias("endpoints"),
        F.count_if(endpoint & F.col("_ready") & F.col("_ahead")).alias("usable_windows"))


def align_points(obs: DataFrame, points: DataFrame, keys: Sequence[str], rows: int = SPAN) -> DataFrame:
    """General backward as-of: each point gets struct ``obs`` (t, payload...) of the latest row at or before it.

    ``obs`` has ``keys``, ``t`` (unique per key) and payload columns; ``points``
    has ``keys``, ``g`` and any others.  Segments hold about ``rows`` of both, however dense they are.
    """
    payload = [c for c in obs.columns if c not in keys]
    others = [c for c in points.columns if c not in keys]
    left = obs.select(*keys, F.col("t").alias("_o"), F.lit(0).alias("_kind"),
                      F.struct(*payload).alias("obs"), F.lit(None).cast(points.select(F.struct(*others)).schema[0].dataType).alias("_p"))
    right = points.select(*keys, F.col("g").alias("_o"), F.lit(1).alias("_kind"),
                          F.lit(None).cast(left.schema["obs"].dataType).alias("obs"), F.struct(*others).alias("_p"))
    both = balanced(left.unionByName(right), keys, "_o", rows)
    both = both.withColumn("_ord", F.struct("_o", "_kind"))
    return last_known(both, keys, "_ord", {"obs": F.col("obs")}).where(F.col("_kind") == 1).select(
        *keys, "_p.*", "obs")
