"""Step schedules, dose integrals, event templates, state features, scaling, exposure."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.functions.columns import is_finite, rate_constants
from tracksieve.operators.ordered import SEG, SPAN, balanced, dense_rows, next_row, previous_row, running_sum, segmented, spread_join, with_halo

STEP_SPAN = 1 << 16


def step_schedule(obs: DataFrame, cases: DataFrame, rate: Column, rows: int = SPAN) -> DataFrame:
    """Right-continuous knots (caseid, t, rate) in relative seconds.

    ``obs`` (caseid, t, ...) is unique per timestamp; rows whose ``rate`` is null
    are left out.  Equal neighbours are merged; a schedule that starts later (or
    has no row) begins with rate 0 at time 0.
    """
    r = spread_join(obs, cases, ["caseid"], "t").where(F.col("t").between(F.col("w0"), F.col("w1"))).select(
        "caseid", (F.col("t") - F.col("w0")).alias("t"), rate.alias("rate")).where(F.col("rate").isNotNull())
    first = r.groupBy("caseid").agg(F.min("t").alias("_f"))
    zero = cases.select("caseid").join(first, "caseid", "left").where(F.col("_f").isNull() | (F.col("_f") > 0)).select(
        "caseid", F.lit(0.0).alias("t"), F.lit(0.0).alias("rate"))
    p = previous_row(balanced(r.unionByName(zero), ["caseid"], "t", rows), ["caseid"], "t", ["rate"])
    return p.where(~F.col("rate").eqNullSafe(F.col("prev.rate"))).select("caseid", "t", "rate")


def schedule_intervals(schedule: DataFrame, cases: DataFrame, rows: int = SPAN) -> DataFrame:
    """(caseid, t_from, t_to, rate, horizon): each knot lasts until the next one or the horizon."""
    n = next_row(balanced(schedule, ["caseid"], "t", rows), ["caseid"], "t", ["t"])
    h = cases.select("caseid", (F.col("w1") - F.col("w0")).alias("horizon"))
    return spread_join(n, h, ["caseid"], "t").select(
        "caseid", F.col("t").alias("t_from"), F.coalesce(F.col("next.t"), F.col("horizon")).alias("t_to"), "rate", "horizon")


def dose_between(start: Column, end: Column, minute: float = 60.0) -> Column:
    """Amount an interval row contributes to [start, end] (0 where they do not meet)."""
    left, right = F.greatest(F.col("t_from"), start), F.least(F.col("t_to"), end)
    return F.when(right > left, F.col("rate") * (right - left) / minute).otherwise(0.0)


def dose_integrals(intervals: DataFrame, recent: float = 60.0, minute: float = 60.0) -> DataFrame:
    """Total amount and amount of the last ``recent`` seconds per case."""
    h = F.col("horizon")
    return intervals.groupBy("caseid").agg(
        F.first("horizon").alias("horizon"), F.count(F.lit(1)).alias("knots"), F.sum(dose_between(F.lit(0.0), h, minute)).alias("total_amount"),
        F.sum(dose_between(F.greatest(F.lit(0.0), h - recent), h, minute)).alias("recent_amount"))


def step_doses(intervals: DataFrame, cases: DataFrame, step: float = 10.0, minute: float = 60.0) -> DataFrame:
    """(caseid, step_no, dose, mean_rate) for every complete step; an interval is split over the steps it meets."""
    last = F.ceil(F.col("t_to") / step) - 1
    parts = dense_rows(intervals.where(F.col("t_to") > F.col("t_from")), "caseid", F.floor(F.col("t_from") / step), last, "step_no", STEP_SPAN)
    d = parts.groupBy("caseid", "step_no").agg(F.sum(dose_between(F.col("step_no") * step, (F.col("step_no") + 1) * step, minute)).alias("dose"))
    n = F.floor((F.col("w1") - F.col("w0")) / step)
    every = dense_rows(cases, "caseid", F.lit(0), n - 1, "step_no", STEP_SPAN).select("caseid", "step_no")
    return every.join(d, ["caseid", "step_no"], "left").select(
        "caseid", "step_no", F.coalesce("dose", F.lit(0.0)).alias("dose"), (F.coalesce("dose", F.lit(0.0)) * minute / step).alias("mean_rate"))


def complete_horizon(cases: DataFrame, step: float = 10.0) -> DataFrame:
    """Horizon cut to whole steps; ``usable`` is false below one step."""
    h = F.floor((F.col("w1") - F.col("w0")) / step) * step
    return cases.select("caseid", h.cast("double").alias("horizon"), (h >= step).alias("usable"))


def event_template(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Signal events in relative time: (caseid, t, in_range, quality, accepted).

    ``pairs`` (caseid, t, v, quality) are deduplicated signal rows with the
    quality of the same timestamp (null where there is none).
    """
    r = spread_join(pairs, cases, ["caseid"], "t")
    ok = F.col("v").between(0, 100)
    return r.select("caseid", (F.col("t") - F.col("w0") + F.lit(0.0)).alias("t"), ok.alias("in_range"), "quality",
                    (ok & F.coalesce(F.col("quality") >= 50, F.lit(False))).alias("accepted"))


def template_counters(events: DataFrame) -> DataFrame:
    q = F.col("quality")
    return events.groupBy("caseid").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("in_range").alias("in_range"), F.count_if(~F.col("in_range")).alias("out_of_range"),
        F.count(q).alias("quality_matches"), F.count_if((q < 0) | (q > 100)).alias("quality_outside_range"), F.count_if("accepted").alias("accepted"))


def template_payload(events: DataFrame, chunk_seconds: float) -> DataFrame:
    """Array payload in bounded chunks: (caseid, chunk, n, events ARRAY<STRUCT<t, in_range, quality>>) in time order.

    A case of any length becomes several rows, never one unbounded array.
    """
    return events.groupBy("caseid", F.floor(F.col("t") / chunk_seconds).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("t", "in_range", "quality"))).alias("events"))


def payload_problems(payload: DataFrame, horizons: DataFrame, chunk_seconds: float) -> DataFrame:
    """(caseid, problem): not strictly increasing, outside the horizon, outside the own chunk, or a wrong size."""
    e = F.col("events")
    later = F.zip_with(F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), e, lambda a, b: a["t"] > b["t"])
    rising = F.forall(F.slice(later, 1, F.greatest(F.size(e) - 1, F.lit(0))), lambda x: F.coalesce(x, F.lit(False)))
    j = payload.join(horizons.select("caseid", "horizon"), "caseid")
    found = F.array_compact(F.array(
        F.when(~rising, "not_strictly_increasing"),
        F.when(F.exists(e, lambda x: (x["t"] < 0) | (x["t"] > F.col("horizon"))), "outside_horizon"),
        F.when(F.exists(e, lambda x: F.floor(x["t"] / chunk_seconds) != F.col("chunk")), "outside_chunk"),
        F.when(F.size(e) != F.col("n"), "wrong_size")))
    return j.select("caseid", F.explode(found).alias("problem")).groupBy("caseid", "problem").agg(F.count(F.lit(1)).alias("chunks"))


def dose_features(doses: DataFrame, lags: int = 6, span: int = STEP_SPAN) -> DataFrame:
    """Per step: the last ``lags`` doses (0 before the start), their sum and the running total."""
    total = running_sum(segmented(doses, "step_no", span), ["caseid"], "step_no", {"cumulative": F.col("dose")}).select("caseid", "step_no", "dose", "cumulative")
    h = with_halo(total, "step_no", span, lags - 1, 0)
    w = Window.partitionBy("caseid", SEG).orderBy("step_no")
    return h.select(
        "caseid", "step_no", "_home", "cumulative", F.sum("dose").over(w.rowsBetween(-(lags - 1), 0)).alias("recent"),
        *[F.coalesce(F.lag("dose", j).over(w), F.lit(0.0)).alias(f"dose_t{j}") for j in range(lags)]).where("_home").drop("_home")


def lookup_features(aligned: DataFrame, value: Column, mask: Column, age: Column, lags: int, empty_age: float) -> DataFrame:
    """Per grid point the (value, mask, age) of the last ``lags`` points; before the start (0, 0, empty_age).

    ``aligned`` must carry a halo of lags-1 points before each segment.
    """
    base = aligned.select("caseid", SEG, "slot", "k", "_home", value.alias("value"), mask.alias("mask"), age.alias("age"))
    w = Window.partitionBy("caseid", SEG).orderBy("slot")
    cols = [F.coalesce(F.lag(c, j).over(w), F.lit(e)).alias(f"{c}_t{j}") for j in range(lags) for c, e in (("value", 0.0), ("mask", 0.0), ("age", empty_age))]
    return base.select("caseid", "slot", "k", "_home", *cols).where("_home").drop("_home")


def fit_scaler(rows: DataFrame, fields: Sequence[str], identity: Sequence[str] = ()) -> DataFrame:
    """(field, n, center, scale): mean and sample SD; SD <= 1e-12 gives 1, identity fields (0, 1)."""
    long = rows.select(*[F.col(f).cast("double").alias(f) for f in fields]).unpivot([], list(fields), "field", "x")
    s = long.groupBy("field").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    keep = F.col("field").isin(*identity) if identity else F.lit(False)
    return s.select("field", "n", F.when(keep, 0.0).otherwise(F.col("m")).alias("center"),
                    F.when(keep | (F.col("s") <= 1e-12), 1.0).otherwise(F.col("s")).alias("scale"))


def apply_scaler(rows: DataFrame, scaler: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(x - center) / scale for every field; the fitted values reach the rows as one small map (one entry per field)."""
    table = scaler.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("center", "scale")))).alias("_m")).scalar()
    r = rows.withColumn("_m", table)
    return r.select(*keys, *[((F.col(f) - F.col("_m")[f]["center"]) / F.col("_m")[f]["scale"]).alias(f) for f in fields])


def verify_scaler(fitted: DataFrame, frozen: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(field, verdict) of a scaler fitted again against the frozen one: ok, missing, unknown, invalid (not finite, scale <= 0) or different."""
    z = frozen.select("field", F.col("center").alias("_c"), F.col("scale").alias("_s"), F.lit(True).alias("_frozen"))
    j = fitted.withColumn("_fitted", F.lit(True)).join(z, "field", "full_outer")

    def apart(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(F.lit(1.0), F.abs(a))

    valid = is_finite("_c") & is_finite("_s") & (F.col("_s") > 0)
    verdict = (F.when(F.col("_frozen").isNull(), "missing").when(F.col("_fitted").isNull(), "unknown").when(~F.coalesce(valid, F.lit(False)), "invalid")
               .when(apart("center", "_c") | apart("scale", "_s"), "different").otherwise("ok"))
    return j.select("field", verdict.alias("verdict"))


def scaled_rejects(scaled: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, field, reason) of every scaled value that must not be used: null, nan or infinite.  Empty means all finite."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNull(), "null").when(F.isnan(f), "nan").when(F.abs(f) == float("inf"), "infinite").alias("reason")) for f in fields])
    return scaled.select(*keys, F.inline(F.filter(cells, lambda c: c["reason"].isNotNull())))


# --- exposure by superposition -------------------------------------------------
# The compartment model is linear, so the state at a time is the sum of what each
# constant-rate interval leaves behind.  The sum combines map-side: no recursion,
# no per-case loop, no limit on intervals per case.

def _left_behind(k: Column, at: Column, minute: float) -> Column:
    """exp(-k (at - end)) - exp(-k (at - start)) of an interval that ended before ``at``."""
    start, end = F.least(F.col("t_from"), at), F.least(F.col("t_to"), at)
    return F.exp(-k * (at - end) / minute) - F.exp(-k * (at - start) / minute)


def one_compartment_amount(k: Column | float, at: Column, minute: float = 60.0) -> Column:
    k = F.lit(float(k)) if isinstance(k, (int, float)) else k
    return F.sum(F.col("rate") / k * _left_behind(k, at, minute))


def modal_parameters(p: Mapping[str, Column]) -> dict[str, Column]:
    """Hybrid rates l1..l3 and plasma coefficients a1..a3 of a three-compartment model, in closed form."""
    k = rate_constants(p)
    s2 = k["k10"] + k["k12"] + k["k13"] + k["k21"] + k["k31"]
    s1 = k["k10"] * k["k31"] + k["k21"] * k["k31"] + k["k21"] * k["k13"] + k["k10"] * k["k21"] + k["k31"] * k["k12"]
    s0 = k["k10"] * k["k21"] * k["k31"]
    a, b = s1 - s2 * s2 / 3, 2 * s2 * s2 * s2 / 27 - s1 * s2 / 3 + s0
    radius = F.sqrt(-(a * a * a) / 27)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -b / 2 / radius))) / 3
    size = 2 * F.cbrt(radius)
    out = {f"l{j + 1}": s2 / 3 - F.cos(angle + 2 * math.pi * j / 3) * size for j in range(3)}
    out.update({"k21": k["k21"], "k31": k["k31"], "v1": p["v1"], "ke0": p["ke0"]})
    return out


def modal_coefficients() -> dict[str, Column]:
    """a1..a3 over columns l1..l3, k21, k31, v1 (kept apart so the roots are computed once)."""
    out = {}
    for j in (1, 2, 3):
        l = F.col(f"l{j}")
        others = [F.col(f"l{i}") for i in (1, 2, 3) if i != j]
        out[f"a{j}"] = (l - F.col("k21")) * (l - F.col("k31")) / ((l - others[0]) * (l - others[1]) * F.col("v1"))
    return out


def three_compartment(intervals: DataFrame, patients: DataFrame, at: Column, minute: float = 60.0) -> DataFrame:
    """(caseid, plasma, effect): concentrations at ``at``; ``patients`` has caseid, l1..l3, a1..a3, ke0."""
    r = spread_join(intervals, patients, ["caseid"], "t_from")
    ke0 = F.col("ke0")
    plasma = F.lit(0.0)
    effect = F.lit(0.0)
    for j in (1, 2, 3):
        l, a = F.col(f"l{j}"), F.col(f"a{j}")
        e = _left_behind(l, at, minute) / l
        plasma = plasma + a * e
        effect = effect + ke0 * a / (ke0 - l) * (e - _left_behind(ke0, at, minute) / ke0)
    return r.groupBy("caseid").agg(F.sum(F.col("rate") * plasma).alias("plasma"), F.sum(F.col("rate") * effect).alias("effect"))
