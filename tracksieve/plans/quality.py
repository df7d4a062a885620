"""Quality queries: case records, scenarios, marginal thresholds, category samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import r6
from tracksieve.functions.quantiles import distribution
from tracksieve.operators import quality, sequence as sq, sweep
from tracksieve.plans import fixtures as fx
from tracksieve.plans import sequences, sweeps
from tracksieve.plans.registry import Query

DAY = 86400

# The named scenarios at driver-table scale: same shape, other thresholds.
SCENARIOS = {
    "permissive": (
        ("duration_short", "duration", ">=", 27 * DAY), ("common_span_short", "common_span", ">=", 18 * DAY),
        ("share_0_100_low", "share_0_100", ">=", 0.60), ("positive_a_few", "positive_a", ">=", 1),
        ("positive_b_few", "positive_b", ">=", 1), ("negative_rates_many", "negative_rates", "<=", 14)),
    "moderate": (
        ("duration_short", "duration", ">=", 28 * DAY), ("common_span_short", "common_span", ">=", 22 * DAY),
        ("share_10_100_low", "share_10_100", ">=", 0.30), ("share_ge_50_low", "share_ge_50", ">=", 0.40),
        ("positive_a_few", "positive_a", ">=", 3), ("positive_b_few", "positive_b", ">=", 3),
        ("negative_rates_many", "negative_rates", "<=", 10)),
    "strict": (
        ("duration_short", "duration", ">=", 28.5 * DAY), ("common_span_short", "common_span", ">=", 24 * DAY),
        ("share_10_100_low", "share_10_100", ">=", 0.40), ("share_ge_50_low", "share_ge_50", ">=", 0.50),
        ("positive_a_few", "positive_a", ">=", 5), ("positive_b_few", "positive_b", ">=", 5),
        ("negative_rates_many", "negative_rates", "<=", 8)),
}

MARGINAL = (
    *[("window_duration", "duration", ">=", n * DAY) for n in (20, 27, 28, 28.5, 29)],
    *[("common_span", "common_span", ">=", n * DAY) for n in (10, 20, 24, 26)],
    *[("common_span_ratio", "common_ratio", ">=", p) for p in (.5, .7, .8, .9, .95)],
    *[("range_fraction", m, ">=", p) for m in ("share_0_100", "share_10_100") for p in (.5, .7, .8, .9, .95)],
    *[("quality_fraction", f"share_ge_{q}", ">=", p) for q in (20, 50, 80) for p in (.5, .7, .8, .9, .95)],
    *[("timestamp_gap", f"gap_{t}", "<=", n * DAY) for t in fx.PRIMARY for n in (2, 4, 6, 8, 10)],
    *[("rate_evidence", m, ">=", n) for m in ("positive_a", "positive_b") for n in (1, 3)],
    *[("rate_evidence", "positive_both", ">=", n) for n in (1, 3)],
)


def records(spark: SparkSession, d: str) -> DataFrame:
    return quality.case_record(fx.signal(spark, d, nan=True, quality=True), fx.cases(spark, d), fx.SIG, fx.QLT, fx.RATE_A, fx.RATE_B)


def _share(num: str, track: str) -> str:
    return f"count(*) FILTER (WHERE inn AND track='{track}' AND {num})/nullif(count(x) FILTER (WHERE inn AND track='{track}'),0)"


REC = dict(
    rb=f"""SELECT caseid, count(x) FILTER (WHERE inn AND track='SIG')::BIGINT AS signal_finite, {_share('x BETWEEN 0 AND 100', 'SIG')} AS share_0_100,
      {_share('x BETWEEN 10 AND 100', 'SIG')} AS share_10_100, count(x) FILTER (WHERE inn AND track='QLT')::BIGINT AS quality_finite,
      {', '.join(f"{_share(f'x>={q}', 'QLT')} AS share_ge_{q}" for q in (20, 50, 80))},
      count(*) FILTER (WHERE inn AND track='RATE_A' AND x>0)::BIGINT AS positive_a, count(*) FILTER (WHERE inn AND track='RATE_B' AND x>0)::BIGINT AS positive_b,
      count(*) FILTER (WHERE inn AND track IN ('RATE_A','RATE_B') AND x<0)::BIGINT AS negative_rates, bool_or(coalesce(d<0,false)) AS any_negative_interval
      FROM raw GROUP BY 1""",
    rg="SELECT caseid, " + ", ".join(f"max(d) FILTER (WHERE track='{t}' AND d>0) AS gap_{t}" for t in fx.PRIMARY) + " FROM win GROUP BY 1",
    rd="SELECT caseid, max(c)>1 AS any_duplicate FROM (SELECT caseid, track, t, count(*) AS c FROM raw GROUP BY ALL) GROUP BY 1",
    spn="""SELECT caseid, CASE WHEN count(*)=3 THEN greatest(0.0, min(l)-max(f)) END AS common_span FROM (
      SELECT caseid, track, arg_min(t,seq) AS f, arg_max(t,seq) AS l FROM raw WHERE inn AND track IN ('SIG','RATE_A','RATE_B') GROUP BY 1,2) GROUP BY 1""",
    rec="""SELECT cs.caseid, w1-w0 AS duration, common_span, common_span/(w1-w0) AS common_ratio, rb.* EXCLUDE (caseid), rg.* EXCLUDE (caseid), any_duplicate,
      least(positive_a, positive_b) AS positive_both FROM cs LEFT JOIN rb USING (caseid) LEFT JOIN rg USING (caseid) LEFT JOIN rd USING (caseid) LEFT JOIN spn USING (caseid)""",
)


def _scenario_sql() -> str:
    parts = []
    for name, criteria in SCENARIOS.items():
        reasons = ", ".join(f"CASE WHEN NOT coalesce({m}{op}{th},false) THEN '{r}' END" for r, m, op, th in criteria)
        parts.append(f"SELECT caseid, '{name}' AS scenario, concat_ws('|', {reasons}) AS reasons FROM rec")
    return "SELECT *, reasons='' AS passes FROM (" + " UNION ALL ".join(parts) + ")"


SC = dict(sc=_scenario_sql())


def rec_sql(body: str, **more: str) -> str:
    return sequences.seq_sql(body, quality=True, **REC, **more)


def quality_records(spark: SparkSession, d: str) -> DataFrame:
    return sequences._r(records(spark, d))


def scenarios(spark: SparkSession, d: str) -> DataFrame:
    return quality.scenario_results(records(spark, d), SCENARIOS)


def scenario_rows(spark: SparkSession, d: str) -> DataFrame:
    return scenarios(spark, d).withColumn("reasons", F.array_join("reasons", "|"))


def scenario_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.reason_counts(scenarios(spark, d))


REASONS_SQL = rec_sql("""SELECT scenario, reason, count(*)::BIGINT AS cases, 'reason' AS kind FROM (
  SELECT scenario, unnest(string_split(reasons,'|')) AS reason FROM sc WHERE reasons<>'') GROUP BY 1,2
  UNION ALL SELECT scenario, CASE WHEN reasons='' THEN 'PASS' ELSE reasons END, count(*)::BIGINT, 'combination' FROM sc GROUP BY 1,2""", **SC)


def scenario_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.scenario_summary(scenarios(spark, d)).withColumn("pass_fraction", r6("pass_fraction"))


def scenario_disagreement(spark: SparkSession, d: str) -> DataFrame:
    names = tuple(SCENARIOS)
    wide = scenarios(spark, d).groupBy("caseid").agg(*[F.max(F.when(F.col("scenario") == n, F.col("passes"))).alias(n) for n in names])
    return sweep.disagreement(sweep.pass_masks(wide, names), names)


def marginal(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).withColumn("positive_both", F.least("positive_a", "positive_b"))
    return quality.marginal_sweep(r, MARGINAL).withColumn("pass_fraction", r6("pass_fraction"))


MARGINAL_SQL = rec_sql(" UNION ALL ".join(
    f"""SELECT '{cat}' AS category, '{m}' AS metric, '{op}{th:g}' AS threshold, count(*) FILTER (WHERE {m}{op}{th})::BIGINT AS pass_count,
    count(*) FILTER (WHERE {m} IS NULL)::BIGINT AS missing_count, (count(*)-count(*) FILTER (WHERE {m}{op}{th}))::BIGINT AS fail_count,
    round(count(*) FILTER (WHERE {m}{op}{th})/count(*),6)+0.0 AS pass_fraction FROM rec""" for cat, m, op, th in MARGINAL))

_GAP = "greatest(gap_SIG, gap_RATE_A, gap_RATE_B)"
CATEGORY_SQL = {
    "signal_no_finite": "signal_finite=0", "share_10_100_30_to_40": "share_10_100>=0.3 AND share_10_100<0.4",
    "share_10_100_40_to_50": "share_10_100>=0.4 AND share_10_100<0.5", "quality_ge_50_40_to_50": "share_ge_50>=0.4 AND share_ge_50<0.5",
    "a_no_positive": "positive_a=0", "b_no_positive": "positive_b=0", "negative_rate": "negative_rates>0",
    "common_span_20_24_days": f"common_span>={20 * DAY} AND common_span<{24 * DAY}", "common_span_24_26_days": f"common_span>={24 * DAY} AND common_span<{26 * DAY}",
    "longest_gap_4_8_days": f"{_GAP}>{4 * DAY} AND {_GAP}<={8 * DAY}", "longest_gap_8_16_days": f"{_GAP}>{8 * DAY} AND {_GAP}<={16 * DAY}",
    "duplicate_or_negative_interval": "any_duplicate OR any_negative_interval",
}


def categories() -> dict:
    c = F.col
    longest = F.greatest("gap_SIG", "gap_RATE_A", "gap_RATE_B")

    def between(m, lo, hi):
        return (m >= lo) & (m < hi)

    return {
        "signal_no_finite": c("signal_finite") == 0, "share_10_100_30_to_40": between(c("share_10_100"), .3, .4),
        "share_10_100_40_to_50": between(c("share_10_100"), .4, .5), "quality_ge_50_40_to_50": between(c("share_ge_50"), .4, .5),
        "a_no_positive": c("positive_a") == 0, "b_no_positive": c("positive_b") == 0, "negative_rate": c("negative_rates") > 0,
        "common_span_20_24_days": between(c("common_span"), 20 * DAY, 24 * DAY), "common_span_24_26_days": between(c("common_span"), 24 * DAY, 26 * DAY),
        "longest_gap_4_8_days": (longest > 4 * DAY) & (longest <= 8 * DAY), "longest_gap_8_16_days": (longest > 8 * DAY) & (longest <= 16 * DAY),
        "duplicate_or_negative_interval": c("any_duplicate") | c("any_negative_interval")}


def boundary_samples(spark: SparkSession, d: str) -> DataFrame:
    return quality.category_samples(records(spark, d), categories(), 20260720, 5)


BOUNDARY_SQL = rec_sql("""SELECT category, caseid, n AS category_size FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY
   sha256('20260720'||chr(0)||category||chr(0)||caseid), caseid) AS r, count(*) OVER (PARTITION BY category)::BIGINT AS n FROM ("""
    + " UNION ALL ".join(f"SELECT '{k}' AS category, caseid FROM rec WHERE {c}" for k, c in CATEGORY_SQL.items()) + ")) WHERE r<=5")


def boundary_sizes(spark: SparkSession, d: str) -> DataFrame:
    return quality.category_sizes(records(spark, d), categories())


def track_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of cadence and adaptive boundary per track, over present tracks."""
    e = sq.track_cadence(fx.signal(spark, d, nan=True), fx.cases(spark, d, inverted=True))
    long = e.select("track", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("median_step", "gap_bound")])).alias("_m")).select("track", "_m.*")
    return distribution(long, ["track", "measure"], "value")


CADENCE_SQL = sequences.seq_sql("""SELECT track, measure, count(value)::BIGINT AS available_count, count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing_count,
  min(value) AS minimum, max(value) AS maximum, """ + ", ".join(f"quantile_disc(value,{p}) AS {n}" for n, p in (
    ("q01", .01), ("q05", .05), ("q25", .25), ("median", .5), ("q75", .75), ("q95", .95), ("q99", .99))) + """
  FROM (SELECT track, 'median_step' AS measure, median_step AS value FROM ev WHERE present UNION ALL SELECT track, 'gap_bound', gap_bound FROM ev WHERE present)
  GROUP BY 1,2""", cs="csi", **sequences.EVIDENCE_CTES)


def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.pattern_counts(records(spark, d))


PATTERN_SQL = rec_sql("""SELECT CASE WHEN positive_a>0 AND positive_b>0 THEN 'both_positive' WHEN positive_a>0 THEN 'a_only_positive'
  WHEN positive_b>0 THEN 'b_only_positive' ELSE 'both_zero_or_nonpositive' END||CASE WHEN negative_rates>0 THEN '|negative_rate_present' ELSE '' END AS pattern,
  count(*)::BIGINT AS cases FROM rec GROUP BY 1""")


def scenario_confusion(spark: SparkSession, d: str) -> DataFrame:
    return sweep.scenario_confusion(scenarios(spark, d), sweeps.counts(spark, d), fx.MIN_WINDOWS)


def confusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return sweep.reasons_among_fail_but_meets(scenarios(spark, d), sweeps.counts(spark, d), fx.MIN_WINDOWS)


def _confusion_sql(body: str) -> str:
    raw = sequences.RAW.format(cs="cs").replace("sgn s", "sgnq s")
    return fx.sql(body, *sweeps.NEEDS, "sgnq", "cs", **sweeps.CTE, raw=raw, win=sequences.WIN.format(raw="raw"), **REC, **SC)


CONFUSION_SQL = _confusion_sql("""SELECT scenario, candidate_id, minimum, (count(*) FILTER (WHERE passes AND usable_windows=0))::BIGINT AS pass_but_zero,
  count(*) FILTER (WHERE passes AND usable_windows<minimum)::BIGINT AS pass_but_below, count(*) FILTER (WHERE NOT passes AND usable_windows>=minimum)::BIGINT AS fail_but_meets,
  count(*) FILTER (WHERE passes AND usable_windows>=minimum)::BIGINT AS both_pass, count(*) FILTER (WHERE NOT passes AND usable_windows<minimum)::BIGINT AS both_fail
  FROM sc JOIN cnt USING (caseid), (SELECT unnest([5,10,20,40,80])::BIGINT AS minimum) GROUP BY 1,2,3""")
CONFUSION_REASONS_SQL = _confusion_sql("""SELECT scenario, candidate_id, minimum, reason, count(*)::BIGINT AS cases FROM (
  SELECT sc.caseid, scenario, unnest(string_split(reasons,'|')) AS reason FROM sc WHERE NOT passes) JOIN cnt USING (caseid),
  (SELECT unnest([5,10,20,40,80])::BIGINT AS minimum) WHERE usable_windows>=minimum GROUP BY 1,2,3,4""")

REC_ROUNDED = "SELECT * EXCLUDE (positive_both) REPLACE (" + ", ".join(
    f"round({c},6)+0.0 AS {c}" for c in ("common_ratio", "share_0_100", "share_10_100", "share_ge_20", "share_ge_50", "share_ge_80")) + ") FROM rec"

QUERIES = {
    "quality_records": Query(quality_records, rec_sql(REC_ROUNDED)),
    "quality_scenarios": Query(scenario_rows, rec_sql("SELECT * FROM sc", **SC)),
    "scenario_reasons": Query(scenario_reasons, REASONS_SQL),
    "scenario_summary": Query(scenario_summary, rec_sql("""SELECT scenario, count(*)::BIGINT AS cases, count(*) FILTER (WHERE passes)::BIGINT AS pass_count,
      count(*) FILTER (WHERE NOT passes)::BIGINT AS fail_count, round(avg(passes::INT),6)+0.0 AS pass_fraction FROM sc GROUP BY 1""", **SC)),
    "scenario_disagreement": Query(scenario_disagreement, rec_sql("""SELECT a.scenario AS "left", b.scenario AS "right",
      count(*) FILTER (WHERE a.passes<>b.passes)::BIGINT AS disagreements FROM sc a JOIN sc b USING (caseid) GROUP BY 1,2""", **SC)),
    "marginal_sweep": Query(marginal, MARGINAL_SQL),
    "boundary_samples": Query(boundary_samples, BOUNDARY_SQL),
    "boundary_sizes": Query(boundary_sizes, rec_sql("SELECT category, count(*) FILTER (WHERE m)::BIGINT AS cases FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS category, {c} AS m FROM rec" for k, c in CATEGORY_SQL.items()) + ") GROUP BY 1")),
    "track_cadence": Query(track_cadence, CADENCE_SQL),
    "pattern_counts": Query(pattern_counts, PATTERN_SQL),
    "scenario_confusion": Query(scenario_confusion, CONFUSION_SQL),
    "scenario_confusion_reasons": Query(confusion_reasons, CONFUSION_REASONS_SQL),
}
