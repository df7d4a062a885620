"""Queries over recorded rows: intervals, values, runs, shares, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import is_finite, r6
from tracksieve.functions.quantiles import RECORD_QUANTILES
from tracksieve.operators import sequence as sq
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query

GAPS = (43200, 86400, 172800, 259200)
BOUNDS = (43200, 86400, 172800, 432000)
EVIDENCE_TRACKS = (fx.EXP, fx.RATE_A, fx.RATE_B, fx.SIG)
GROUPS = {"agent": (fx.EXP,), "support": (fx.RATE_A, fx.RATE_B)}


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double for comparison."""
    return df.select(*[r6(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rows(spark: SparkSession, d: str, *, nan: bool = True, quality: bool = False, inverted: bool = False) -> DataFrame:
    return sq.rows_of(fx.signal(spark, d, nan=nan, quality=quality), fx.cases(spark, d, inverted=inverted))


# oracle: rows with finite value x, recorded order, and window rows with their own previous row
RAW = """SELECT s.caseid, track, seq, t, v, w0, w1, CASE WHEN isfinite(v) THEN v END AS x, t BETWEEN w0 AND w1 AS inn,
  t-lag(t) OVER w AS d, lag(CASE WHEN isfinite(v) THEN v END) OVER w AS px FROM sgn s JOIN {cs} USING (caseid) WINDOW w AS (PARTITION BY s.caseid, track ORDER BY seq)"""
WIN = """SELECT caseid, track, seq, t, v, x, w0, w1, t-lag(t) OVER w AS d, lag(x) OVER w AS px
  FROM {raw} WHERE inn WINDOW w AS (PARTITION BY caseid, track ORDER BY seq)"""


def seq_sql(body: str, *, cs: str = "cs", quality: bool = False, **more: str) -> str:
    raw = RAW.format(cs=cs).replace("sgn s", "sgnq s" if quality else "sgn s")
    return fx.sql(body, "sgnq" if quality else "sgn", cs, raw=raw, win=WIN.format(raw="raw"), **more)


def interval_stats(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    both = [sq.interval_stats(sq.with_previous(x), GAPS).withColumn("scope", F.lit(name))
            for name, x in (("raw", r), ("window", sq.inside(r)))]
    return _r(both[0].unionByName(both[1]))


def _interval_sql(scope: str, src: str) -> str:
    return f"""SELECT '{scope}' AS scope, caseid, track, count(*)::BIGINT AS rows, count(*) FILTER (WHERE d>0)::BIGINT AS positive_intervals,
  (count(*)-count(DISTINCT t))::BIGINT AS duplicate_timestamps,
  count(*) FILTER (WHERE d=0)::BIGINT AS zero_intervals, count(*) FILTER (WHERE d<0)::BIGINT AS negative_intervals,
  min(d) FILTER (WHERE d>0) AS minimum, max(d) FILTER (WHERE d>0) AS longest_gap,
  {', '.join(f"count(*) FILTER (WHERE d>{g})::BIGINT AS gap_gt_{g}" for g in GAPS)},
  {', '.join(f"quantile_disc(d,{p}) FILTER (WHERE d>0) AS q{n}" for n, p in (("05", .05), ("25", .25), ("75", .75), ("95", .95)))},
  median(d) FILTER (WHERE d>0) AS median FROM {src} GROUP BY 2,3"""


INTERVAL_SQL = seq_sql(_interval_sql("raw", "raw") + " UNION ALL BY NAME " + _interval_sql("window", "win"))


def window_position(spark: SparkSession, d: str) -> DataFrame:
    return _r(sq.window_position(rows(spark, d)))


POSITION_SQL = seq_sql("""SELECT *, round(observed_span/wl,6)+0.0 AS span_ratio FROM (SELECT *, CASE WHEN first_inside IS NOT NULL
   THEN greatest(0.0, last_inside-first_inside) END::DOUBLE AS observed_span FROM (SELECT caseid, track, count(*)::BIGINT AS rows,
  count(*) FILTER (WHERE t<w0)::BIGINT AS rows_before, count(*) FILTER (WHERE inn)::BIGINT AS rows_inside,
  count(*) FILTER (WHERE t>w1)::BIGINT AS rows_after, arg_min(t,seq) AS first_t, arg_max(t,seq) AS last_t,
  arg_min(t,seq) FILTER (WHERE inn) AS first_inside, arg_max(t,seq) FILTER (WHERE inn) AS last_inside, any_value(w1-w0) AS wl
  FROM raw GROUP BY 1,2)) """).replace("SELECT *, round(observed_span", "SELECT * EXCLUDE (wl), round(observed_span")


def value_stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(sq.value_stats(sq.with_previous(sq.inside(rows(spark, d)))))


VALUE_SQL = seq_sql(f"""SELECT caseid, track, count(x)::BIGINT AS finite, count(*) FILTER (WHERE v IS NULL)::BIGINT AS missing,
  count(*) FILTER (WHERE isnan(v))::BIGINT AS nonfinite, round(min(x),6)+0.0 AS minimum, round(max(x),6)+0.0 AS maximum,
  count(DISTINCT x)::BIGINT AS unique_values, count(*) FILTER (WHERE x<>px)::BIGINT AS value_changes,
  {', '.join(f"round(quantile_disc(x,{p}),6)+0.0 AS {n}" for n, p in RECORD_QUANTILES.items())} FROM win GROUP BY 1,2""")


def constant_run(spark: SparkSession, d: str) -> DataFrame:
    coarse = F.when(is_finite("v"), F.floor(F.col("v") / 50).cast("double"))
    r = sq.rows_of(fx.signal(spark, d, nan=True).withColumn("v", coarse), fx.cases(spark, d))
    return sq.longest_constant_run(sq.with_previous(sq.inside(r)))


CONSTANT_SQL = seq_sql("""SELECT caseid, track, max(n)::BIGINT AS longest_samples, count(*)::BIGINT AS runs FROM (
  SELECT caseid, track, g, count(*) AS n FROM (SELECT *, sum(st) OVER (PARTITION BY caseid, track ORDER BY seq) AS g FROM (
    SELECT *, CASE WHEN floor(x/50)=lag(floor(x/50)) OVER (PARTITION BY caseid, track ORDER BY seq) THEN 0 ELSE 1 END AS st FROM win))
  WHERE x IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2""")


def gap_runs_fixed(spark: SparkSession, d: str) -> DataFrame:
    w = sq.with_adaptive_bound(sq.with_previous(sq.inside(rows(spark, d)).where(F.col("track").isin(fx.RATE_A, fx.RATE_B))))
    w = w.withColumn("x", F.when(F.col("x") < 0, 0.0).otherwise(F.col("x"))).withColumn(
        "prev", F.struct(F.col("prev.t").alias("t"), F.when(F.col("prev.x") < 0, 0.0).otherwise(F.col("prev.x")).alias("x")))
    return _r(sq.bounded_runs(w, sq.POSITIVE_AND_ZERO, sq.fixed_and_adaptive_bounds(BOUNDS)))


GAP_FIXED_SQL = seq_sql("""SELECT caseid, track, predicate, boundary, count(*)::BIGINT AS runs, max(sec)+0.0 AS longest_seconds, sum(sec)+0.0 AS total_seconds
FROM (SELECT caseid, track, predicate, boundary, g, sum(add) AS sec FROM (
  SELECT *, sum(st) OVER (PARTITION BY caseid, track, predicate, boundary ORDER BY seq) AS g FROM (
    SELECT caseid, track, seq, p AS predicate, boundary, CASE WHEN p=pp AND d>0 AND d<=b THEN 0 ELSE 1 END AS st,
      CASE WHEN p=pp AND d>0 AND d<=b THEN d ELSE 0.0 END AS add
    FROM (SELECT *, CASE WHEN x>0 THEN 'positive' WHEN x<=0 THEN 'zero' END AS p, CASE WHEN px>0 THEN 'positive' WHEN px<=0 THEN 'zero' END AS pp,
            3*median(CASE WHEN d>0 THEN d END) OVER (PARTITION BY caseid, track) AS ab FROM win WHERE track IN ('RATE_A','RATE_B')) w,
      LATERAL (SELECT unnest(['adaptive',""" + ", ".join(f"'fixed_{b}'" for b in BOUNDS) + """]) AS boundary, unnest([ab,""" + ", ".join(f"{b}.0" for b in BOUNDS) + """]) AS b) u
    WHERE p IS NOT NULL)) GROUP BY 1,2,3,4,5) GROUP BY 1,2,3,4""")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    cases = fx.cases(spark, d, inverted=True)
    e = sq.track_evidence(fx.signal(spark, d, nan=True), cases)
    return sq.complete_evidence(e, cases, (*EVIDENCE_TRACKS, "NEVER"))


EVIDENCE_CTES = dict(
    ab="SELECT caseid, track, median(d) FILTER (WHERE d>0) AS med FROM win GROUP BY 1,2",
    wr="""SELECT *, sum(st) OVER (PARTITION BY caseid, track ORDER BY seq) AS g FROM (SELECT w.*, 3*med AS b,
      CASE WHEN x>0 AND px>0 AND d>0 AND d<=3*med THEN 0 ELSE 1 END AS st FROM win w JOIN ab USING (caseid, track))""",
    rn="""SELECT caseid, track, count(*) AS runs, max(s) AS longest, sum(s) AS total FROM (
      SELECT caseid, track, g, sum(CASE WHEN st=0 THEN d ELSE 0 END) AS s FROM wr WHERE x>0 GROUP BY 1,2,3) GROUP BY 1,2""",
    wc="""SELECT w.caseid, w.track, count(*) AS samples, count(x) AS finite, count(*) FILTER (WHERE x>0) AS positive, any_value(med) AS med,
      count(*) FILTER (WHERE d=0) AS z, count(*) FILTER (WHERE d<0) AS ng, count(*) FILTER (WHERE d>3*med) AS lg, count(*)-count(DISTINCT t) AS dup
      FROM win w JOIN ab USING (caseid, track) GROUP BY 1,2""",
    wl="""SELECT caseid, track, bool_or(coalesce(x>0,false)) AS pa, count(*) FILTER (WHERE isnan(v)) AS nf FROM raw GROUP BY 1,2""",
    ev="""SELECT e.caseid, e.track, pa IS NOT NULL AS present, coalesce(pa,false) AS positive_anywhere, w1>=w0 AS valid_window,
      coalesce(nf,0)::BIGINT AS nonfinite_values, coalesce(samples,0)::BIGINT AS samples, coalesce(finite,0)::BIGINT AS finite,
      coalesce(positive,0)::BIGINT AS positive, med AS median_step, 3*med AS gap_bound, coalesce(z,0)::BIGINT AS zero_intervals,
      coalesce(ng,0)::BIGINT AS negative_intervals, coalesce(lg,0)::BIGINT AS long_gaps, coalesce(dup,0)::BIGINT AS duplicate_timestamps,
      coalesce(runs,0)::BIGINT AS runs, coalesce(longest,0)+0.0 AS longest_seconds, coalesce(total,0)+0.0 AS total_seconds,
      CASE WHEN finite>0 THEN positive/finite END AS positive_proportion,
      CASE WHEN pa IS NULL THEN '' ELSE concat_ws('|', CASE WHEN positive>0 AND med IS NULL THEN 'continuity_boundary_unavailable' END,
        CASE WHEN dup>0 THEN 'duplicate_timestamp' END, CASE WHEN w1<w0 THEN 'inverted_window' END, CASE WHEN lg>0 THEN 'long_gap' END,
        CASE WHEN ng>0 THEN 'negative_interval' END, CASE WHEN nf>0 THEN 'nonfinite_value' END, CASE WHEN z>0 THEN 'zero_interval' END) END AS flags
      FROM (SELECT csi.*, unnest(['EXP','RATE_A','RATE_B','SIG','NEVER']) AS track FROM csi) e
      LEFT JOIN wl ON e.caseid=wl.caseid AND e.track=wl.track LEFT JOIN wc ON e.caseid=wc.caseid AND e.track=wc.track
      LEFT JOIN rn ON e.caseid=rn.caseid AND e.track=rn.track""",
)


def gap_runs_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return _r(evidence(spark, d).withColumn("flags", F.array_join("flags", "|")))


GAP_ADAPTIVE_SQL = seq_sql("SELECT * REPLACE (round(positive_proportion,6)+0.0 AS positive_proportion) FROM ev", cs="csi", **EVIDENCE_CTES)


def naive_runs(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    both = [sq.naive_runs(x).withColumn("scope", F.lit(n)) for n, x in (("raw", r), ("window", sq.inside(r)))]
    return both[0].unionByName(both[1])


def _naive_sql(scope: str, src: str) -> str:
    return f"""SELECT '{scope}' AS scope, caseid, track, count(*)::BIGINT AS runs, max(greatest(0.0, tl-tf))::DOUBLE AS longest_seconds FROM (
  SELECT caseid, track, g, arg_min(t,seq) AS tf, arg_max(t,seq) AS tl FROM (
    SELECT *, sum(CASE WHEN x>0 AND coalesce(px>0,false) THEN 0 ELSE 1 END) OVER (PARTITION BY caseid, track ORDER BY seq) AS g FROM {src})
  WHERE x>0 GROUP BY 1,2,3) GROUP BY 2,3"""


NAIVE_SQL = seq_sql(_naive_sql("raw", "raw") + " UNION ALL " + _naive_sql("window", "win"))


def range_shares(spark: SparkSession, d: str) -> DataFrame:
    return _r(sq.range_shares(sq.inside(rows(spark, d)).where(F.col("track") == fx.SIG)))


RANGE_SQL = seq_sql("""SELECT caseid, track, count(x)::BIGINT AS finite, count(*) FILTER (WHERE x=0)::BIGINT AS equal_zero,
  count(*) FILTER (WHERE x<0)::BIGINT AS negative, count(*) FILTER (WHERE x>=0 AND x<10)::BIGINT AS from_0_below_10,
  count(*) FILTER (WHERE x BETWEEN 10 AND 100)::BIGINT AS from_10_to_100, count(*) FILTER (WHERE x>100)::BIGINT AS above_100,
  count(*) FILTER (WHERE x BETWEEN 0 AND 100)::BIGINT AS from_0_to_100,
  """ + ", ".join(f"arg_{m}(t,seq) FILTER (WHERE {c}) AS {w}_{n}" for n, c in (
    ("finite", "x IS NOT NULL"), ("0_100", "x BETWEEN 0 AND 100"), ("10_100", "x BETWEEN 10 AND 100")) for w, m in (("first", "min"), ("last", "max"))) + """,
  round(count(*) FILTER (WHERE x BETWEEN 0 AND 100)/nullif(count(x),0),6)+0.0 AS share_0_100,
  round(count(*) FILTER (WHERE x BETWEEN 10 AND 100)/nullif(count(x),0),6)+0.0 AS share_10_100 FROM win WHERE track='SIG' GROUP BY 1,2""")


def quality_shares(spark: SparkSession, d: str) -> DataFrame:
    return _r(sq.quality_shares(sq.inside(rows(spark, d, quality=True)).where(F.col("track") == fx.QLT)))


QUALITY_SQL = seq_sql("""SELECT caseid, track, count(x)::BIGINT AS finite, count(*) FILTER (WHERE x<0)::BIGINT AS negative,
  count(*) FILTER (WHERE x>100)::BIGINT AS above_100, """ + ", ".join(
    f"count(*) FILTER (WHERE x>={q})::BIGINT AS ge_{q}, round(count(*) FILTER (WHERE x>={q})/nullif(count(x),0),6)+0.0 AS share_ge_{q}" for q in (20, 50, 80))
    + " FROM win WHERE track='QLT' GROUP BY 1,2", quality=True)


def rate_block(spark: SparkSession, d: str) -> DataFrame:
    return _r(sq.rate_block(sq.inside(rows(spark, d)).where(F.col("track").isin(fx.RATE_A, fx.RATE_B))))


RATE_SQL = seq_sql("""SELECT caseid, track, count(x)::BIGINT AS finite, count(*) FILTER (WHERE x<0)::BIGINT AS negative,
  count(*) FILTER (WHERE x=0)::BIGINT AS zero, count(*) FILTER (WHERE x>0)::BIGINT AS positive,
  arg_min(t,seq) FILTER (WHERE x IS NOT NULL) AS first_finite, arg_max(t,seq) FILTER (WHERE x IS NOT NULL) AS last_finite,
  arg_min(t,seq) FILTER (WHERE x>0) AS first_positive, arg_max(t,seq) FILTER (WHERE x>0) AS last_positive,
  round(count(*) FILTER (WHERE x>0)/nullif(count(x),0),6)+0.0 AS share_positive FROM win WHERE track IN ('RATE_A','RATE_B') GROUP BY 1,2""")


def case_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _r(sq.case_rollup(evidence(spark, d), GROUPS))


def _rollup_cols() -> str:
    parts = []
    for name, cond in (("any", "true"), ("agent", "track='EXP'"), ("support", "track IN ('RATE_A','RATE_B')")):
        parts.append(f"""coalesce(bool_or(positive>0) FILTER (WHERE {cond}),false) AS positive_{name},
          coalesce(max(longest_seconds) FILTER (WHERE {cond}),0)+0.0 AS longest_{name},
          coalesce(max(positive_proportion) FILTER (WHERE {cond}),0)+0.0 AS proportion_{name}""")
    return ", ".join(parts)


ROLLUP_CTE = f"""SELECT caseid, {_rollup_cols()}, bool_or(positive_anywhere) AS positive_anywhere, bool_or(valid_window) AS valid_window,
  sum(duplicate_timestamps)::BIGINT AS duplicate_timestamps, sum(zero_intervals)::BIGINT AS zero_intervals,
  sum(negative_intervals)::BIGINT AS negative_intervals, sum(long_gaps)::BIGINT AS long_gaps,
  count(*) FILTER (WHERE flags<>'')::BIGINT AS warning_tracks FROM ev GROUP BY 1"""
ROLLUP_SQL = seq_sql("SELECT * REPLACE (" + ", ".join(f"round(proportion_{n},6)+0.0 AS proportion_{n}" for n in ("any", "agent", "support"))
                     + ") FROM ru", cs="csi", **EVIDENCE_CTES, ru=ROLLUP_CTE)


def track_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Expected (case, track) rows with status and parse results, absent ones included."""
    r = rows(spark, d, inverted=True)
    w = sq.parse_warnings(sq.with_previous(r))
    x = F.col("x")
    inn = F.col("t").between(F.col("w0"), F.col("w1"))
    n = r.groupBy(*sq.KEYS).agg(F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"),
                                F.count_if(inn & (x > 0)).alias("window_positive"))
    names = F.array(*[F.lit(t) for t in (*EVIDENCE_TRACKS, "NEVER")])
    expected = fx.cases(spark, d).select("caseid", F.explode(names).alias("track"))
    m = expected.join(w, list(sq.KEYS), "left").join(n, list(sq.KEYS), "left")
    status = (F.when(F.col("samples").isNull(), "track_absent")
              .when((F.col("caseid") % 13 == 0) & (F.col("track") == fx.EXP), "failed")
              .when(F.col("finite") < 10, "empty_signal").otherwise("complete"))
    return m.withColumn("present", F.col("samples").isNotNull()).withColumn("status", status)


def case_status(spark: SparkSession, d: str) -> DataFrame:
    return sq.case_status(track_manifest(spark, d))


TRACK_ROWS = """SELECT e.caseid, e.track, n, pos, neg, wp, fin, warn, CASE WHEN n IS NULL THEN 'track_absent' WHEN e.caseid%13=0 AND e.track='EXP' THEN 'failed'
     WHEN fin<10 THEN 'empty_signal' ELSE 'complete' END AS st
   FROM (SELECT csi.caseid, unnest(['EXP','RATE_A','RATE_B','SIG','NEVER']) AS track FROM csi) e LEFT JOIN (
     SELECT caseid, track, count(*) AS n, count(x) AS fin, count(*) FILTER (WHERE x>0) AS pos, count(*) FILTER (WHERE x<0) AS neg,
       count(*) FILTER (WHERE x>0 AND inn) AS wp,
       count(*)>count(DISTINCT t) OR bool_or(coalesce(x<0,false)) OR bool_or(coalesce(isnan(v),false)) OR bool_or(coalesce(d<0,false)) AS warn
     FROM raw GROUP BY 1,2) m ON e.caseid=m.caseid AND e.track=m.track"""
CASE_STATUS_SQL = seq_sql("""SELECT *, CASE WHEN failed_tracks>0 THEN 'failed' WHEN present_tracks=0 THEN 'complete_no_allowed_tracks_present'
  WHEN empty_tracks>0 THEN 'complete_with_empty_signal' ELSE 'complete' END AS case_status FROM (
 SELECT caseid, count(*) FILTER (WHERE n IS NOT NULL)::BIGINT AS present_tracks, count(*) FILTER (WHERE n IS NULL)::BIGINT AS absent_tracks,
  count(*) FILTER (WHERE st='complete')::BIGINT AS complete_tracks, count(*) FILTER (WHERE st='empty_signal')::BIGINT AS empty_tracks,
  count(*) FILTER (WHERE st='failed')::BIGINT AS failed_tracks, bool_or(coalesce(pos>0,false)) AS positive_anywhere,
  bool_or(coalesce(wp>0,false)) AS positive_inside, count(*) FILTER (WHERE st='complete' AND fin>0 AND pos=0 AND neg=0)::BIGINT AS all_zero_tracks,
  count(*) FILTER (WHERE warn)::BIGINT AS warning_tracks
 FROM ("""+TRACK_ROWS+""") GROUP BY 1)""", cs="csi")


def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return sq.track_summary(track_manifest(spark, d))


TRACK_SUMMARY_SQL = seq_sql("""SELECT track, count(*)::BIGINT AS expected_cases, count(n)::BIGINT AS present_cases, count(*) FILTER (WHERE st='complete')::BIGINT AS complete,
  count(*) FILTER (WHERE st='empty_signal')::BIGINT AS empty_signal, count(*) FILTER (WHERE st='failed')::BIGINT AS failed, count(*) FILTER (WHERE st='track_absent')::BIGINT AS track_absent,
  count(*) FILTER (WHERE st='complete' AND fin>0 AND pos=0 AND neg=0)::BIGINT AS all_zero_cases, count(*) FILTER (WHERE pos>0)::BIGINT AS positive_cases,
  count(*) FILTER (WHERE wp>0)::BIGINT AS window_positive_cases, count(*) FILTER (WHERE warn)::BIGINT AS warning_cases FROM (""" + TRACK_ROWS + ") GROUP BY 1", cs="csi")


def warning_flags(spark: SparkSession, d: str) -> DataFrame:
    w = sq.parse_warnings(sq.with_previous(rows(spark, d)))
    return w.withColumn("warnings", F.array_join("warnings", "|"))


WARNING_SQL = seq_sql("""SELECT caseid, track, count(*)::BIGINT AS samples, count(x)::BIGINT AS finite,
  concat_ws('|', CASE WHEN count(*)>count(DISTINCT t) THEN 'duplicate_timestamp' END, CASE WHEN count(*) FILTER (WHERE x<0)>0 THEN 'negative_value' END,
   CASE WHEN count(*) FILTER (WHERE isnan(v))>0 THEN 'nonfinite_value' END, CASE WHEN count(*) FILTER (WHERE d<0)>0 THEN 'nonmonotonic_timestamp' END) AS warnings
  FROM raw GROUP BY 1,2""")


QUERIES = {
    "interval_stats": Query(interval_stats, INTERVAL_SQL),
    "window_position": Query(window_position, POSITION_SQL),
    "value_stats": Query(value_stats, VALUE_SQL),
    "constant_run": Query(constant_run, CONSTANT_SQL),
    "gap_runs_fixed": Query(gap_runs_fixed, GAP_FIXED_SQL),
    "gap_runs_adaptive": Query(gap_runs_adaptive, GAP_ADAPTIVE_SQL),
    "naive_runs": Query(naive_runs, NAIVE_SQL),
    "range_shares": Query(range_shares, RANGE_SQL),
    "quality_shares": Query(quality_shares, QUALITY_SQL),
    "rate_block": Query(rate_block, RATE_SQL),
    "case_rollup": Query(case_rollup, ROLLUP_SQL),
    "case_status": Query(case_status, CASE_STATUS_SQL),
    "track_summary": Query(track_summary, TRACK_SUMMARY_SQL),
    "warning_flags": Query(warning_flags, WARNING_SQL),
}
