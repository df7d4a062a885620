"""Sweep queries: 4 quality rules x 3 signal caps x 5 hold caps over one alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import parse_candidate_id, r6
from tracksieve.functions.quantiles import RECORD_QUANTILES
from tracksieve.operators import align, sweep
from tracksieve.plans import fixtures as fx
from tracksieve.plans.alignment import RATE_LOOKUPS, grid
from tracksieve.plans.registry import Query

RULE_LOOKUPS = tuple(
    align.Lookup(name, fx.SIG, 0.0, 100.0, None if cut is None else fx.QLT, cut) for name, cut in fx.RULES.items())
RATES = tuple(x.name for x in RATE_LOOKUPS)
CANDIDATES = tuple(f"{r}__sig{s}s__rate{c}s" for r in fx.RULES for s in fx.SIGNAL_CAPS for c in fx.RATE_CAPS)


def classes(spark: SparkSession, d: str) -> DataFrame:
    a = grid(spark, d, (*RULE_LOOKUPS, *RATE_LOOKUPS), halo=True)
    return sweep.endpoint_classes(a, tuple(fx.RULES), RATES, fx.SIGNAL_CAPS, fx.RATE_CAPS, fx.HISTORY, fx.TARGET)


def counts(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sweep_counts(classes(spark, d), fx.cases(spark, d), tuple(fx.RULES), fx.SIGNAL_CAPS, fx.RATE_CAPS)


# Oracle: every candidate aligned on its own, as the definition says.
_POINTS = " UNION ALL ".join(
    f"""SELECT '{r}' AS rule, s.caseid, s.k, s.n, s.age AS sa, s.dup AS sd, CASE WHEN a.v>=0 THEN a.age END AS aa, a.dup AS ad,
     CASE WHEN b.v>=0 THEN b.age END AS ba, b.dup AS bd FROM as_{r} s JOIN as_RATE_A a USING (caseid,k) JOIN as_RATE_B b USING (caseid,k)""" for r in fx.RULES)
_CANDS = "SELECT * FROM (SELECT unnest([{}]) AS signal_cap), (SELECT unnest([{}]) AS rate_cap)".format(
    ",".join(f"{c}::BIGINT" for c in fx.SIGNAL_CAPS), ",".join(f"{c}::BIGINT" for c in fx.RATE_CAPS))
_NAIVE = """SELECT rule, caseid, signal_cap, rate_cap, k, n, s, a, b, t, coalesce(sdu OR adu OR bdu,false) OR (t AND tdu) AS dup FROM (
  SELECT rule, caseid, signal_cap, rate_cap, k, n, min(su) OVER w AS s, min(au) OVER w AS a, min(bu) OVER w AS b,
    max(su AND sd) OVER w AS sdu, max(au AND ad) OVER w AS adu, max(bu AND bd) OVER w AS bdu,
    coalesce(lead(su,3) OVER o,false) AS t, coalesce(lead(sd,3) OVER o,false) AS tdu
  FROM (SELECT *, coalesce(sa<=signal_cap+1e-9,false) AS su, coalesce(aa<=rate_cap+1e-9,false) AS au, coalesce(ba<=rate_cap+1e-9,false) AS bu FROM pts, cand)
  WINDOW w AS (PARTITION BY rule, caseid, signal_cap, rate_cap ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
         o AS (PARTITION BY rule, caseid, signal_cap, rate_cap ORDER BY k)) WHERE k>=5 AND k<n-3"""
_CNT = """SELECT c.caseid, c.rule, c.signal_cap, c.rate_cap, c.rule||'__sig'||c.signal_cap||'s__rate'||c.rate_cap||'s' AS candidate_id,
  count(k)::BIGINT AS endpoints, count(*) FILTER (WHERE s AND a AND b)::BIGINT AS usable_history, count(*) FILTER (WHERE t)::BIGINT AS usable_targets,
  count(*) FILTER (WHERE s AND a AND b AND t)::BIGINT AS usable_windows, count(*) FILTER (WHERE NOT s)::BIGINT AS fail_s,
  count(*) FILTER (WHERE NOT a)::BIGINT AS fail_a, count(*) FILTER (WHERE NOT b)::BIGINT AS fail_b, count(*) FILTER (WHERE NOT t)::BIGINT AS fail_t,
  count(*) FILTER (WHERE dup)::BIGINT AS duplicate_affected
FROM (SELECT cs.caseid, unnest(['none','ge_20','ge_50','ge_80']) AS rule, cand.* FROM cs, cand) c LEFT JOIN nv USING (caseid, rule, signal_cap, rate_cap) GROUP BY ALL"""
CTE = dict(pts=_POINTS, cand=_CANDS, nv=_NAIVE, cnt=_CNT)
NEEDS = ("as_none", "as_ge_20", "as_ge_50", "as_ge_80", "as_RATE_A", "as_RATE_B")


def sweep_sql(body: str, **more: str) -> str:
    return fx.sql(body, *NEEDS, **CTE, **more)


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sweep_overlaps(classes(spark, d), fx.SIGNAL_CAPS, fx.RATE_CAPS)


OVERLAPS_SQL = sweep_sql("""SELECT rule, signal_cap, rate_cap, CASE WHEN c='' THEN 'PASS' ELSE c END AS combination, count(*)::BIGINT AS endpoints FROM (
  SELECT *, concat_ws('|', CASE WHEN NOT s THEN 'history_signal_unavailable' END, CASE WHEN NOT a THEN 'history_rate_a_unavailable' END,
    CASE WHEN NOT b THEN 'history_rate_b_unavailable' END, CASE WHEN NOT t THEN 'target_signal_unavailable' END) AS c FROM nv) GROUP BY ALL""")


def summary(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sweep_summary(counts(spark, d))


SUMMARY_SQL = sweep_sql("SELECT candidate_id, count(*)::BIGINT AS cases, " + ", ".join(
    f"sum({c})::BIGINT AS {c}" for c in ("endpoints", "usable_history", "usable_targets", "usable_windows", "fail_s", "fail_a", "fail_b", "fail_t"))
    + """, count(*) FILTER (WHERE usable_windows>0)::BIGINT AS usable_cases, count(*) FILTER (WHERE usable_windows=0)::BIGINT AS zero_window_cases,
    min(usable_windows)::DOUBLE AS minimum, max(usable_windows)::DOUBLE AS maximum, """ + ", ".join(
    f"quantile_disc(usable_windows,{p})::DOUBLE AS {n}" for n, p in RECORD_QUANTILES.items()) + " FROM cnt GROUP BY 1")


def min_windows(spark: SparkSession, d: str) -> DataFrame:
    out = sweep.minimum_window_sensitivity(counts(spark, d), fx.MIN_WINDOWS)
    return out.withColumn("pass_fraction", r6("pass_fraction"))


MIN_SQL_BODY = """SELECT candidate_id, minimum, count(*) FILTER (WHERE usable_windows>=minimum)::BIGINT AS pass_cases,
  count(*) FILTER (WHERE usable_windows<minimum)::BIGINT AS fail_cases, round(count(*) FILTER (WHERE usable_windows>=minimum)/count(*),6)+0.0 AS pass_fraction
  FROM cnt, (SELECT unnest([5,10,20,40,80])::BIGINT AS minimum) GROUP BY 1,2"""


def rate_alignment(spark: SparkSession, d: str) -> DataFrame:
    out = sweep.rate_alignment(grid(spark, d, RATE_LOOKUPS), RATES, fx.RATE_CAPS)
    return out.withColumn("usable_fraction", r6("usable_fraction"))


RATE_SQL = fx.sql("""SELECT track, hold_cap, count(*)::BIGINT AS grid_points, count(*) FILTER (WHERE u)::BIGINT AS usable, count(*) FILTER (WHERE NOT u)::BIGINT AS unavailable,
  count(*) FILTER (WHERE u AND v>0)::BIGINT AS usable_positive, count(*) FILTER (WHERE u AND v=0)::BIGINT AS usable_zero,
  count(*) FILTER (WHERE v>=0 AND NOT u)::BIGINT AS hold_cap_exceeded, count(*) FILTER (WHERE v<0)::BIGINT AS latest_negative,
  count(*) FILTER (WHERE v IS NULL)::BIGINT AS no_prior, count(*) FILTER (WHERE u AND dup)::BIGINT AS duplicate_used,
  round(count(*) FILTER (WHERE u)/count(*),6)+0.0 AS usable_fraction
FROM (SELECT *, coalesce(v>=0 AND age<=hold_cap+1e-9,false) AS u FROM (SELECT 'ra' AS track, * FROM as_RATE_A UNION ALL SELECT 'rb', * FROM as_RATE_B),
   (SELECT unnest([""" + ",".join(map(str, fx.RATE_CAPS)) + "])::BIGINT AS hold_cap)) GROUP BY 1,2", "as_RATE_A", "as_RATE_B")


def disagreement(spark: SparkSession, d: str) -> DataFrame:
    return sweep.disagreement(sweep.candidate_masks(counts(spark, d), CANDIDATES), CANDIDATES)


DISAGREEMENT_SQL = sweep_sql("""SELECT a.candidate_id AS "left", b.candidate_id AS "right", count(*) FILTER (WHERE (a.usable_windows>0)<>(b.usable_windows>0))::BIGINT AS disagreements
  FROM cnt a JOIN cnt b USING (caseid) GROUP BY 1,2""")


def candidate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the counted candidates, parsed back into their parts."""
    c = counts(spark, d).groupBy("candidate_id").agg(F.max("usable_windows").alias("largest"))
    return c.select("candidate_id", "largest", parse_candidate_id("candidate_id").alias("p")).select("candidate_id", "largest", "p.*")


QUERIES = {
    "sweep_counts": Query(counts, sweep_sql("SELECT * FROM cnt")),
    "sweep_overlaps": Query(overlaps, OVERLAPS_SQL),
    "sweep_summary": Query(summary, SUMMARY_SQL),
    "min_window_sensitivity": Query(min_windows, sweep_sql(MIN_SQL_BODY)),
    "rate_alignment": Query(rate_alignment, RATE_SQL),
    "sweep_disagreement": Query(disagreement, DISAGREEMENT_SQL),
    "candidate_ids": Query(candidate_ids, sweep_sql("SELECT candidate_id, rule, signal_cap, rate_cap, max(usable_windows) AS largest FROM cnt GROUP BY ALL")),
}
