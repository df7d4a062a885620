"""Alignment queries: deduplication, grids, as-of lookups, usable windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import r6
from tracksieve.operators import align, ordered
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query

SIGNAL_CAP, RATE_CAP = 172800.0, 432000.0

ANY_SIGNAL = align.Lookup("sig", fx.SIG, 0.0, 100.0)
RAW_SIGNAL = align.Lookup("raw", fx.SIG, quality_track=fx.QLT)
GOOD_SIGNAL = align.Lookup("good", fx.SIG, 0.0, 100.0, fx.QLT, 50.0)
RATE_LOOKUPS = (align.Lookup("ra", fx.RATE_A), align.Lookup("rb", fx.RATE_B))


def grid(spark: SparkSession, d: str, lookups, *, halo: bool = False, span: int = align.GRID_SPAN) -> DataFrame:
    needs_quality = any(x.quality_track for x in lookups)
    return align.align_study(
        fx.signal(spark, d, quality=needs_quality), fx.cases(spark, d), fx.PRIMARY, lookups, fx.STEP,
        before=fx.HISTORY - 1 if halo else 0, after=fx.TARGET if halo else 0, span=span)


def causal_windows(spark: SparkSession, d: str) -> DataFrame:
    a = grid(spark, d, (ANY_SIGNAL, *RATE_LOOKUPS), halo=True)
    ok_rates = [align.blocking_state(x.name, RATE_CAP) > 0 for x in RATE_LOOKUPS]
    return align.usable_windows(a, align.capped("sig", SIGNAL_CAP), ok_rates, fx.HISTORY, fx.TARGET)


CAUSAL_WINDOWS_SQL = fx.sql(f"""
SELECT caseid, any_value(n)::BIGINT AS grid_points, count(*) FILTER (WHERE e)::BIGINT AS endpoints,
       count(*) FILTER (WHERE e AND h AND tg)::BIGINT AS usable_windows
FROM (SELECT caseid, n, k>=5 AND k<n-3 AS e,
        min(s AND a AND b) OVER (PARTITION BY caseid ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS h,
        lead(s,3) OVER (PARTITION BY caseid ORDER BY k) AS tg
      FROM (SELECT s.caseid, s.k, s.n, coalesce(s.age<={SIGNAL_CAP}+1e-9,false) AS s,
              coalesce(a.v>=0 AND a.age<={RATE_CAP}+1e-9,false) AS a, coalesce(b.v>=0 AND b.age<={RATE_CAP}+1e-9,false) AS b
            FROM as_none s JOIN as_RATE_A a USING (caseid,k) JOIN as_RATE_B b USING (caseid,k)))
GROUP BY 1""", "as_none", "as_RATE_A", "as_RATE_B")


def dedupe(spark: SparkSession, d: str) -> DataFrame:
    return align.dedupe_last_finite(fx.signal(spark, d, nan=True, quality=True), fx.cases(spark, d)).select(
        "caseid", "track", "t", r6("v").alias("v"), "dup")


DEDUPE_SQL = fx.sql("""SELECT s.caseid, track, t,
  round(arg_max(v, seq) FILTER (WHERE v IS NOT NULL AND isfinite(v)),6)+0.0 AS v, count(*)>1 AS dup
FROM sgnq s JOIN cs USING (caseid) WHERE t BETWEEN w0 AND w1 GROUP BY 1,2,3
HAVING count(*) FILTER (WHERE v IS NOT NULL AND isfinite(v))>0""", "sgnq", "cs")


def index_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.segmented(fx.signal(spark, d, nan=True), "seq")
    return align.index_counters(ordered.previous_row(rows, ["caseid", "track"], "seq", ["t"]), fx.cases(spark, d))


INDEX_COUNTERS_SQL = fx.sql("""
SELECT caseid, track, count(*)::BIGINT AS original_row_count,
  count(*) FILTER (WHERE i AND isfinite(v))::BIGINT AS finite_row_count,
  (count(*) FILTER (WHERE i)-count(DISTINCT CASE WHEN i THEN t END))::BIGINT AS duplicate_timestamp_count,
  count(*) FILTER (WHERE d=0)::BIGINT AS zero_interval_count, count(*) FILTER (WHERE d<0)::BIGINT AS negative_interval_count
FROM (SELECT s.*, t BETWEEN w0 AND w1 AS i, t-lag(t) OVER (PARTITION BY s.caseid, track ORDER BY seq) AS d
      FROM sgn s JOIN cs USING (caseid)) GROUP BY 1,2""", "sgn", "cs")


def asof_capped(spark: SparkSession, d: str) -> DataFrame:
    a = grid(spark, d, (ANY_SIGNAL, GOOD_SIGNAL)).where("_home")
    out = a.select("caseid", "k", "g", align.age("sig").alias("age_any"), align.age("good").alias("age_good"))
    for cap in fx.SIGNAL_CAPS:
        out = out.withColumn(f"ok_any_{cap}", F.coalesce(F.col("age_any") <= cap + 1e-9, F.lit(False)))
        out = out.withColumn(f"ok_good_{cap}", F.coalesce(F.col("age_good") <= cap + 1e-9, F.lit(False)))
    return out


ASOF_CAPPED_SQL = fx.sql("SELECT a.caseid, a.k, a.g, a.age AS age_any, b.age AS age_good, " + ", ".join(
    f"coalesce(a.age<={c}+1e-9,false) AS ok_any_{c}, coalesce(b.age<={c}+1e-9,false) AS ok_good_{c}" for c in fx.SIGNAL_CAPS)
    + " FROM as_none a JOIN as_ge_50 b USING (caseid,k)", "as_none", "as_ge_50")


def asof_blocking(spark: SparkSession, d: str) -> DataFrame:
    a = grid(spark, d, RATE_LOOKUPS).where("_home")
    return a.select("caseid", "k", *[c for x in RATE_LOOKUPS for c in (
        align.blocking_state(x.name, RATE_CAP).alias(f"state_{x.name}"),
        align.blocking_reason(x.name, RATE_CAP).alias(f"reason_{x.name}"))])


def _state(p: str) -> str:
    return (f"CASE WHEN {p}.v IS NULL OR {p}.v<0 OR {p}.age>{RATE_CAP}+1e-9 THEN 0 WHEN {p}.v>0 THEN CASE WHEN {p}.dup THEN 4 ELSE 2 END"
            f" ELSE CASE WHEN {p}.dup THEN 3 ELSE 1 END END")


def _reason(p: str, cap: str = str(RATE_CAP)) -> str:
    return (f"CASE WHEN {p}.v IS NULL THEN 'unavailable_no_prior_finite_observation' WHEN {p}.v<0 THEN 'unavailable_latest_finite_negative'"
            f" WHEN {p}.age>{cap}+1e-9 THEN 'unavailable_hold_cap_exceeded' WHEN {p}.v>0 THEN 'usable_positive' ELSE 'usable_zero' END")


ASOF_BLOCKING_SQL = fx.sql(f"""SELECT a.caseid, a.k, {_state('a')} AS state_ra, {_reason('a')} AS reason_ra,
  {_state('b')} AS state_rb, {_reason('b')} AS reason_rb FROM as_RATE_A a JOIN as_RATE_B b USING (caseid,k)""", "as_RATE_A", "as_RATE_B")

AGE_CLIP = 259200.0


def accept_reason(v, q, threshold: float):
    """Acceptance of one event: range, then exact-timestamp quality."""
    return (
        F.when(v.isNull(), "explicit_missing_event").when(~v.between(0, 100), "signal_out_of_range")
        .when(q.isNull(), "quality_missing_exact_timestamp").when(q < threshold, "quality_below_threshold")
        .otherwise("available"))


def asof_two_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = grid(spark, d, (RAW_SIGNAL, GOOD_SIGNAL)).where("_home")
    raw_age, good_age = F.least(align.age("raw"), F.lit(AGE_CLIP)), align.age("good")
    shown = F.coalesce(good_age <= SIGNAL_CAP, F.lit(False))
    why = accept_reason(F.col("raw.v"), F.col("raw.q"), 50.0)
    return a.select(
        "caseid", "k",
        r6(F.when(shown, F.col("good.v")).otherwise(0.0)).alias("value"), F.when(shown, 1.0).otherwise(0.0).alias("mask"),
        F.when(F.col("raw").isNull(), AGE_CLIP).when(shown, F.least(good_age, F.lit(AGE_CLIP))).otherwise(raw_age).alias("age"),
        F.when(F.col("raw").isNull(), "no_prior_observation").when(shown, "available")
        .when(F.col("good").isNull() | (F.col("raw.t") > F.col("good.t")), why).otherwise("stale_beyond_cap").alias("reason"))


ASOF_TWO_LOOKUP_SQL = fx.sql(f"""SELECT gr.caseid, gr.k, round(CASE WHEN sh THEN gv ELSE 0 END,6)+0.0 AS value,
  CASE WHEN sh THEN 1.0 ELSE 0.0 END::DOUBLE AS mask,
  CASE WHEN rt IS NULL THEN {AGE_CLIP} WHEN sh THEN least(g-gt,{AGE_CLIP}) ELSE least(g-rt,{AGE_CLIP}) END::DOUBLE AS age,
  CASE WHEN rt IS NULL THEN 'no_prior_observation' WHEN sh THEN 'available'
    WHEN gt IS NULL OR rt>gt THEN CASE WHEN NOT rv BETWEEN 0 AND 100 THEN 'signal_out_of_range' WHEN q IS NULL THEN 'quality_missing_exact_timestamp'
      WHEN q<50 THEN 'quality_below_threshold' ELSE 'available' END ELSE 'stale_beyond_cap' END AS reason
FROM (SELECT gr.caseid, gr.k, gr.g, r.t AS rt, r.v AS rv, r.q, b.ot AS gt, b.v AS gv, coalesce(b.age<={SIGNAL_CAP},false) AS sh
      FROM gr ASOF LEFT JOIN (SELECT x.caseid, x.t, x.v, y.v AS q FROM dd x LEFT JOIN dd y ON x.caseid=y.caseid AND x.t=y.t AND y.track='QLT'
        WHERE x.track='SIG') r ON gr.caseid=r.caseid AND gr.g>=r.t JOIN as_ge_50 b ON b.caseid=gr.caseid AND b.k=gr.k) gr""", "as_ge_50")


def exact_ts_join(spark: SparkSession, d: str) -> DataFrame:
    """Signal values with the quality of the same timestamp: one pass, both tracks in one group."""
    rows = align.in_window(fx.signal(spark, d, quality=True), fx.cases(spark, d)).where(F.col("track").isin(fx.SIG, fx.QLT))
    per = rows.groupBy("caseid", "t").agg(*[c for n in (fx.SIG, fx.QLT) for c in (
        F.max(F.when((F.col("track") == n) & F.col("v").isNotNull(), F.struct("seq", "v"))).alias(n),
        (F.count_if(F.col("track") == n) > 1).alias(f"{n}_dup"))])
    q = F.col("QLT.v")
    return per.where(F.col("SIG").isNotNull()).select(
        "caseid", "t", r6("SIG.v").alias("v"), q.alias("quality"),
        (F.col("SIG_dup") | (q.isNotNull() & F.col("QLT_dup"))).alias("dup"),
        accept_reason(F.col("SIG.v"), q, 50.0).alias("reason"))


EXACT_TS_SQL = fx.sql("""SELECT a.caseid, a.t, round(a.v,6)+0.0 AS v, q.v AS quality, a.dup OR coalesce(q.dup,false) AS dup,
  CASE WHEN NOT a.v BETWEEN 0 AND 100 THEN 'signal_out_of_range' WHEN q.v IS NULL THEN 'quality_missing_exact_timestamp'
       WHEN q.v<50 THEN 'quality_below_threshold' ELSE 'available' END AS reason
FROM dd a LEFT JOIN dd q ON a.caseid=q.caseid AND a.t=q.t AND q.track='QLT' WHERE a.track='SIG'""", "dd")


def overlap_fraction(spark: SparkSession, d: str) -> DataFrame:
    rows = align.in_window(fx.signal(spark, d, quality=True), fx.cases(spark, d)).where(
        F.col("v").isNotNull() & F.col("track").isin(fx.SIG, fx.QLT))
    at = rows.groupBy("caseid", "t").agg(
        F.max((F.col("track") == fx.SIG).cast("int")).alias("a"), F.max((F.col("track") == fx.QLT).cast("int")).alias("b"))
    return at.groupBy("caseid").agg(
        F.sum("a").alias("signal_times"), F.sum("b").alias("quality_times"), F.sum(F.col("a") * F.col("b")).alias("overlap"),
    ).select("*", r6(F.col("overlap") / F.nullif("signal_times", F.lit(0))).alias("of_signal"),
             r6(F.col("overlap") / F.nullif("quality_times", F.lit(0))).alias("of_quality"))


OVERLAP_SQL = fx.sql("""SELECT caseid, sum(a)::BIGINT AS signal_times, sum(b)::BIGINT AS quality_times, sum(a*b)::BIGINT AS overlap,
  round(sum(a*b)/nullif(sum(a),0),6)+0.0 AS of_signal, round(sum(a*b)/nullif(sum(b),0),6)+0.0 AS of_quality
FROM (SELECT s.caseid, t, max((track='SIG')::INT) AS a, max((track='QLT')::INT) AS b FROM sgq s JOIN cs USING (caseid)
  WHERE t BETWEEN w0 AND w1 AND v IS NOT NULL AND track IN ('SIG','QLT') GROUP BY 1,2) GROUP BY 1""", "sgq", "cs")


def common_span(spark: SparkSession, d: str) -> DataFrame:
    s = align.common_span(fx.signal(spark, d), fx.cases(spark, d, inverted=True), fx.PRIMARY)
    dur = F.when(F.col("s0").isNotNull(), F.greatest(F.lit(0.0), F.col("s1") - F.col("s0")))
    return s.select("caseid", "s0", "s1", dur.alias("duration"), r6(F.try_divide(dur, F.col("w1") - F.col("w0"))).alias("ratio"),
                    F.array_join("limiting", "|").alias("limiting"))


COMMON_SPAN_SQL = fx.sql("""SELECT csi.caseid, s0, s1, CASE WHEN s0 IS NOT NULL THEN greatest(0.0, s1-s0) END::DOUBLE AS duration,
  round(CASE WHEN s0 IS NOT NULL THEN greatest(0.0, s1-s0) END/(w1-w0),6)+0.0 AS ratio,
  concat_ws('|', CASE WHEN coalesce(ra_f=s0 OR ra_l=s1, ra_f IS NULL) THEN 'RATE_A' END,
    CASE WHEN coalesce(rb_f=s0 OR rb_l=s1, rb_f IS NULL) THEN 'RATE_B' END,
    CASE WHEN coalesce(sg_f=s0 OR sg_l=s1, sg_f IS NULL) THEN 'SIG' END) AS limiting
FROM csi LEFT JOIN (SELECT *, CASE WHEN sg_f IS NOT NULL AND ra_f IS NOT NULL AND rb_f IS NOT NULL THEN greatest(sg_f,ra_f,rb_f) END AS s0,
   CASE WHEN sg_f IS NOT NULL AND ra_f IS NOT NULL AND rb_f IS NOT NULL THEN least(sg_l,ra_l,rb_l) END AS s1 FROM (
   SELECT s.caseid, """ + ", ".join(
    f"arg_min(t,seq) FILTER (WHERE track='{t}') AS {p}_f, arg_max(t,seq) FILTER (WHERE track='{t}') AS {p}_l"
    for t, p in (("SIG", "sg"), ("RATE_A", "ra"), ("RATE_B", "rb"))) + """
   FROM sg s JOIN csi USING (caseid) WHERE t BETWEEN w0 AND w1 GROUP BY 1)) x ON x.caseid=csi.caseid""", "csi")


def grid_visibility(spark: SparkSession, d: str) -> DataFrame:
    a = grid(spark, d, (ANY_SIGNAL, GOOD_SIGNAL)).where("_home")
    p0, p1 = align.capped("sig", fx.SIGNAL_CAPS[2]), align.capped("good", fx.SIGNAL_CAPS[1])
    return a.groupBy("caseid").agg(
        F.count(F.lit(1)).alias("grid_points"), F.count_if(p0).alias("visible_p0"), F.count_if(p1).alias("visible_p1"),
    ).select("*", r6(F.col("visible_p0") / F.col("grid_points")).alias("fraction_p0"),
             r6(F.col("visible_p1") / F.col("grid_points")).alias("fraction_p1"),
             (F.col("visible_p1") == 0).alias("zero_visibility_p1"))


VISIBILITY_SQL = fx.sql(f"""SELECT *, round(visible_p0/grid_points,6)+0.0 AS fraction_p0, round(visible_p1/grid_points,6)+0.0 AS fraction_p1,
  visible_p1=0 AS zero_visibility_p1 FROM (
  SELECT a.caseid, count(*)::BIGINT AS grid_points, count(*) FILTER (WHERE a.age<={fx.SIGNAL_CAPS[2]}+1e-9)::BIGINT AS visible_p0,
   count(*) FILTER (WHERE b.age<={fx.SIGNAL_CAPS[1]}+1e-9)::BIGINT AS visible_p1
  FROM as_none a JOIN as_ge_50 b USING (caseid,k) GROUP BY 1)""", "as_none", "as_ge_50")

QUERIES = {
    "causal_windows": Query(causal_windows, CAUSAL_WINDOWS_SQL),
    "dedupe_last_finite": Query(dedupe, DEDUPE_SQL),
    "index_counters": Query(index_counters, INDEX_COUNTERS_SQL),
    "asof_capped": Query(asof_capped, ASOF_CAPPED_SQL),
    "asof_blocking": Query(asof_blocking, ASOF_BLOCKING_SQL),
    "asof_two_lookup": Query(asof_two_lookup, ASOF_TWO_LOOKUP_SQL),
    "exact_ts_join": Query(exact_ts_join, EXACT_TS_SQL),
    "overlap_fraction": Query(overlap_fraction, OVERLAP_SQL),
    "common_span": Query(common_span, COMMON_SPAN_SQL),
    "grid_visibility": Query(grid_visibility, VISIBILITY_SQL),
}
