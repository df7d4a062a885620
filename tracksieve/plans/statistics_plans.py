"""Episode-metric and paired-statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import inverse_distance_score
from tracksieve.operators import guards as gd, resampling as rs, statistics as st
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r

REPLICATES = 2000

NAMES = tuple((m, c) for m in fx.METRICS for c in st.CONTRASTS)


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    s = fx.signal(spark, d).where((F.col("track") == fx.SIG) & F.col("v").isNotNull())
    cond = F.element_at(F.array(*[F.lit(c) for c in st.CONDITIONS]), (F.col("seq") % 4 + 1).cast("int"))
    return s.select("caseid", cond.alias("condition_id"), F.col("seq").alias("step"), F.col("v").alias("x"),
                    ((F.col("seq") * 13 % 50) / 10.0).alias("rate"), inverse_distance_score(F.col("v")).alias("score"))


TRAJ = dict(tr="""SELECT caseid, ['P0S0','P1S0','P0S1','P1S1'][(seq%4+1)::INT] AS condition_id, seq AS step, v AS x, (seq*13%50)/10.0::DOUBLE AS rate, 1/(abs(50-v)+1) AS score
  FROM sg WHERE track='SIG' AND v IS NOT NULL""", em="""SELECT caseid, condition_id, count(*)::BIGINT AS steps, avg(abs(x-50)) AS mean_absolute_deviation, sqrt(avg((x-50)*(x-50))) AS root_mean_squared_deviation,
  count(*) FILTER (WHERE x BETWEEN 40 AND 60)*10.0 AS seconds_in_range, count(*) FILTER (WHERE x<40)*10.0 AS seconds_below, count(*) FILTER (WHERE x>60)*10.0 AS seconds_above,
  sum(abs(x-50))*10 AS integrated_absolute_error, max(abs(x-50)) AS maximum_absolute_deviation, sum(rate)*10/60 AS total_amount, sum(rate)*10/60/(count(*)*10/60) AS mean_rate,
  coalesce(avg(abs(dr)),0) AS mean_absolute_rate_change, sum(score) AS score_sum FROM (SELECT *, rate-lag(rate) OVER (PARTITION BY caseid, condition_id ORDER BY step) AS dr FROM tr) GROUP BY 1,2""")
METRIC_COLS = ("mean_absolute_deviation", "root_mean_squared_deviation", "seconds_in_range", "seconds_below", "seconds_above", "integrated_absolute_error",
               "maximum_absolute_deviation", "total_amount", "mean_rate", "mean_absolute_rate_change", "score_sum")
_ROUND = ", ".join(f"round({c}::DOUBLE,6)+0.0 AS {c}" for c in METRIC_COLS)


def episode_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.episode_metrics(trajectory(spark, d)))


def failed_episodes(spark: SparkSession, d: str) -> DataFrame:
    m = st.episode_metrics(trajectory(spark, d)).where(~((F.col("caseid") % 10 == 0) & (F.col("condition_id") == "P1S1"))).where("caseid % 15 <> 0")
    fails = fx.cases(spark, d).where("caseid % 15 = 0").select("caseid", F.explode(F.array(*[F.lit(c) for c in st.CONDITIONS])).alias("condition_id"), F.lit("solver_error").alias("reason"))
    return _r(st.with_failures(m, fx.cases(spark, d), st.CONDITIONS, fails)).select("caseid", "condition_id", "completed", "reason", "steps", "score_sum")


FAILED_SQL = fx.sql("""SELECT e.caseid, e.condition_id, steps IS NOT NULL AS completed, CASE WHEN steps IS NOT NULL THEN '' WHEN e.caseid%15=0 THEN 'solver_error' ELSE 'episode_missing' END AS reason, steps, round(score_sum,6)+0.0 AS score_sum
  FROM (SELECT caseid, unnest(['P0S0','P1S0','P0S1','P1S1']) AS condition_id FROM cs) e LEFT JOIN (SELECT * FROM em WHERE NOT (caseid%10=0 AND condition_id='P1S1') AND caseid%15<>0) m ON e.caseid=m.caseid AND e.condition_id=m.condition_id""", "sg", "cs", **TRAJ)


def contrasts(spark: SparkSession, d: str) -> DataFrame:
    return st.case_contrasts(fx.faulty_metrics(spark, d), fx.METRICS)


def subject_rows(spark: SparkSession, d: str) -> DataFrame:
    return st.subject_contrasts(contrasts(spark, d))


def _term(m: str, weights) -> str:
    w = dict(zip(st.CONDITIONS, weights))
    return "+".join(f"({w[c]})*{m}_{c}" for c in st.SUMMATION_ORDER)


def _reason(m: str) -> str:
    cells = [f"count(*) FILTER (WHERE condition_id='{c}')" for c in st.CONDITIONS]
    known = ", ".join(f"'{c}'" for c in st.CONDITIONS)
    return (f"CASE WHEN count(subjectid)<count(*) THEN 'subject_missing' WHEN min(subjectid)<>max(subjectid) THEN 'several_subjects' "
            f"WHEN count(*) FILTER (WHERE condition_id NOT IN ({known}))>0 THEN 'unknown_condition' WHEN greatest({','.join(cells)})>1 THEN 'duplicate_condition' "
            f"WHEN least({','.join(cells)})<1 THEN 'missing_condition' WHEN count(*) FILTER (WHERE NOT isfinite({m}))>0 THEN 'non_finite_value' ELSE '' END")


CON = dict(
    wd="SELECT caseid, min(subjectid) AS subjectid, " + ", ".join(f"{_reason(m)} AS why_{m}" for m in fx.METRICS) + ", "
       + ", ".join(f"max({m}) FILTER (WHERE condition_id='{c}') AS {m}_{c}" for m in fx.METRICS for c in st.CONDITIONS) + " FROM mf GROUP BY 1",
    cc=" UNION ALL ".join(f"SELECT caseid, subjectid, '{m}' AS metric, '{n}' AS contrast, CASE WHEN why_{m}='' THEN {_term(m, w)} END::DOUBLE AS value, why_{m} AS reason FROM wd" for m in fx.METRICS for n, w in st.CONTRASTS.items()),
    sr="SELECT subjectid, metric, contrast, avg(value) AS value, count(value)::BIGINT AS cases, count(*) FILTER (WHERE reason<>'')::BIGINT AS excluded_cases FROM cc GROUP BY 1,2,3",
)
WRAP = "18446744073709551616::UHUGEINT"


def _mixed(x: str, keep: str, source: str) -> str:
    """The 64-bit finalizer of the draws, in 128-bit numbers cut to 64 bits: (keep, h)."""
    one = f"SELECT {keep}, xor(x, x >> 30) * {rs.MIX_A}::UHUGEINT % {WRAP} AS y FROM (SELECT {keep}, ({x}) % {WRAP} AS x FROM {source})"
    two = f"SELECT {keep}, xor(y, y >> 27) * {rs.MIX_B}::UHUGEINT % {WRAP} AS z FROM ({one})"
    return f"SELECT {keep}, xor(z, z >> 31) AS h FROM ({two})"


def _draws(seed: int) -> str:
    start = _mixed(f"(CASE WHEN subjectid < 0 THEN {WRAP} - (-subjectid)::UHUGEINT ELSE subjectid::UHUGEINT END) * {rs.GOLDEN}::UHUGEINT + {seed}", "subjectid", "(SELECT DISTINCT subjectid FROM sr)")
    return f"SELECT subjectid, b, h >> {64 - rs.BITS} AS u FROM ({_mixed(f'h + (b + 1)::UHUGEINT * {rs.GOLDEN}::UHUGEINT', 'subjectid, b', f'({start}), range({REPLICATES}) r(b)')})"


_TIMES = "+".join(f"(u>={t})::INT" for t in rs.poisson_thresholds())
BOOT = dict(
    dw=f"SELECT subjectid, b, {_TIMES} AS w FROM ({_draws(42)})",
    bm="SELECT metric, contrast, b, sum(w*value)/sum(w) AS mean FROM (SELECT * FROM dw WHERE w>0) JOIN (SELECT * FROM sr WHERE value IS NOT NULL) USING (subjectid) GROUP BY 1,2,3",
    bc="SELECT metric, contrast, quantile_cont(mean,0.025) AS ci_low, quantile_cont(mean,0.975) AS ci_high FROM bm GROUP BY 1,2",
)
FLIP = dict(
    fd=f"SELECT subjectid, b, 1-2*(u & 1)::INT AS s FROM ({_draws(42 + st.FLIP_SEED)})",
    fm="SELECT metric, contrast, b, abs(sum(s*value))/count(value) AS f FROM fd JOIN (SELECT * FROM sr WHERE value IS NOT NULL) USING (subjectid) GROUP BY 1,2,3",
    pv=f"SELECT metric, contrast, (count(*) FILTER (WHERE f>=o-1e-9)+1)/{REPLICATES + 1}.0 AS p FROM fm JOIN (SELECT metric, contrast, abs(avg(value)) AS o FROM sr GROUP BY 1,2) USING (metric, contrast) GROUP BY 1,2",
    hm="""SELECT metric, contrast, p, max(least(1.0,(6-r)*p)) OVER (PARTITION BY metric ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted_p
      FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, contrast) AS r FROM pv)""",
)
EFFECT = dict(ef="""SELECT metric, contrast, count(value)::BIGINT AS subjects, avg(value) AS mean_difference, median(value) AS median_difference,
  CASE WHEN stddev_samp(value)>1e-12 THEN avg(value)/stddev_samp(value) END AS dz FROM sr GROUP BY 1,2""")


def con_sql(body: str, **more: str) -> str:
    return fx.sql(body, "mf", **CON, **more)


def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.condition_summary(st.subject_condition_means(fx.metrics_long(spark, d), fx.METRICS)))


SMEAN = dict(sm=" UNION ALL ".join(f"SELECT subjectid, condition_id, '{m}' AS metric, avg({m}) AS value FROM mx GROUP BY 1,2" for m in fx.METRICS))
CONDITION_SQL = fx.sql("""SELECT condition_id, metric, count(*)::BIGINT AS subjects, round(avg(value),6)+0.0 AS mean, round(coalesce(stddev_samp(value),0),6)+0.0 AS sd, round(min(value),6)+0.0 AS minimum, round(max(value),6)+0.0 AS maximum,
  round(quantile_cont(value,0.25),6)+0.0 AS q1, round(median(value),6)+0.0 AS median, round(quantile_cont(value,0.75),6)+0.0 AS q3 FROM sm GROUP BY 1,2""", "mx", **SMEAN)


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.bootstrap_ci(subject_rows(spark, d), NAMES, REPLICATES))


def signflip(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.sign_flip(subject_rows(spark, d), NAMES, REPLICATES))


def holm(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.holm(st.sign_flip(subject_rows(spark, d), NAMES, REPLICATES)))


def effect(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.effect_size(subject_rows(spark, d)))


def table(spark: SparkSession, d: str) -> DataFrame:
    return st.paired_table(subject_rows(spark, d), NAMES, REPLICATES)


TABLE_SQL = con_sql("SELECT metric, contrast, subjects, " + ", ".join(f"round({c},6)+0.0 AS {c}" for c in ("mean_difference", "median_difference", "dz", "ci_low", "ci_high", "p", "adjusted_p"))
                    + " FROM ef JOIN bc USING (metric, contrast) JOIN hm USING (metric, contrast)", **BOOT, **FLIP, **EFFECT)


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Integrity findings of a result with injected faults."""
    cond = st.condition_summary(st.subject_condition_means(fx.metrics_long(spark, d), fx.METRICS))
    cond = cond.withColumn("q1", F.when((F.col("metric") == "m2") & (F.col("condition_id") == "P0S0"), F.col("maximum") + 1).otherwise(F.col("q1")))
    t = table(spark, d).withColumn("adjusted_p", F.when(F.col("contrast") == "interaction", F.col("p") / 2).otherwise(F.col("adjusted_p")))
    t = t.where(~((F.col("metric") == "m3") & (F.col("contrast") == "P1S1_minus_P1S0")))
    want = spark.createDataFrame(list(NAMES), "metric string, contrast string")
    return gd.aggregate_problems(cond, t, want)



INTEGRITY_SQL = con_sql("""SELECT metric, contrast AS item, 'adjusted_ge_raw' AS rule FROM hm WHERE contrast='interaction' AND p/2<p
  UNION ALL SELECT 'm2', 'P0S0', 'q1_le_median' FROM sm WHERE metric='m2' AND condition_id='P0S0' HAVING max(value)+1>median(value)
  UNION ALL SELECT DISTINCT metric, contrast, 'missing_contrast' FROM sr WHERE metric='m3' AND contrast='P1S1_minus_P1S0'""", **FLIP, **SMEAN)

PRECISION = {"m1": 2, "m2": 1, "m3": 4}


def result_tables(spark: SparkSession, d: str) -> DataFrame:
    return st.formatted(table(spark, d), PRECISION, ("mean_difference", "median_difference", "dz", "ci_low", "ci_high", "p", "adjusted_p"))


_DIGITS = "CASE metric " + " ".join(f"WHEN '{m}' THEN {d}" for m, d in PRECISION.items()) + " ELSE 3 END"
_FIXED = ("mean_difference", "median_difference", "dz", "ci_low", "ci_high", "p", "adjusted_p")


def _text(c: str) -> str:
    return "CASE " + _DIGITS + " " + " ".join(f"WHEN {d} THEN printf('%.{d}f', round({c}::DOUBLE,{d})+0.0)" for d in sorted({3, *PRECISION.values()})) + " END"


RESULT_SQL = con_sql("SELECT metric, contrast, subjects, " + ", ".join(f"coalesce({_text(c)}, '') AS {c}" for c in _FIXED)
                     + " FROM ef JOIN bc USING (metric, contrast) JOIN hm USING (metric, contrast)", **BOOT, **FLIP, **EFFECT)


def result_cells(spark: SparkSession, d: str) -> DataFrame:
    return _r(st.cell(st.effect_size(subject_rows(spark, d)), "mean_difference", metric="m1", contrast="interaction"))


QUERIES = {
    "episode_metrics": Query(episode_metrics, fx.sql(f"SELECT caseid, condition_id, steps, {_ROUND} FROM em", "sg", **TRAJ)),
    "failed_episodes": Query(failed_episodes, FAILED_SQL),
    "condition_summary": Query(condition_summary, CONDITION_SQL),
    "paired_contrasts": Query(lambda s, d: _r(contrasts(s, d)), con_sql("SELECT caseid, subjectid, metric, contrast, round(value,6)+0.0 AS value, reason FROM cc")),
    "subject_means": Query(lambda s, d: _r(subject_rows(s, d)), con_sql("SELECT subjectid, metric, contrast, round(value,6)+0.0 AS value, cases, excluded_cases FROM sr")),
    "bootstrap_ci": Query(bootstrap, con_sql("SELECT metric, contrast, round(ci_low,6)+0.0 AS ci_low, round(ci_high,6)+0.0 AS ci_high FROM bc", **BOOT)),
    "signflip_p": Query(signflip, con_sql("SELECT metric, contrast, round(p,6)+0.0 AS p FROM pv", **FLIP)),
    "holm": Query(holm, con_sql("SELECT metric, contrast, round(p,6)+0.0 AS p, round(adjusted_p,6)+0.0 AS adjusted_p FROM hm", **FLIP)),
    "effect_size": Query(effect, con_sql("SELECT metric, contrast, subjects, round(mean_difference,6)+0.0 AS mean_difference, round(median_difference,6)+0.0 AS median_difference, round(dz,6)+0.0 AS dz FROM ef", **EFFECT)),
    "paired_table": Query(lambda s, d: _r(table(s, d)), TABLE_SQL),
    "result_integrity": Query(integrity, INTEGRITY_SQL),
    "result_tables": Query(result_tables, RESULT_SQL),
    "result_cells": Query(result_cells, con_sql("SELECT round(mean_difference,6)+0.0 AS mean_difference FROM ef WHERE metric='m1' AND contrast='interaction'", **EFFECT)),
}
