"""Cohort queries on top of the sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.operators import checksums, cohort as co, sweep
from tracksieve.plans import fixtures as fx
from tracksieve.plans import sweeps
from tracksieve.plans.registry import Query

SELECTED = "ge_50__sig172800s__rate432000s"
MINIMUM = 20
LOOKUPS = (
    ("quality_rule", "none", "none__sig172800s__rate432000s", MINIMUM), ("quality_rule", "ge_20", "ge_20__sig172800s__rate432000s", MINIMUM),
    ("quality_rule", "ge_80", "ge_80__sig172800s__rate432000s", MINIMUM), ("signal_staleness", "1_day", "ge_50__sig86400s__rate432000s", MINIMUM),
    ("signal_staleness", "3_days", "ge_50__sig259200s__rate432000s", MINIMUM), ("rate_hold", "2_days", "ge_50__sig172800s__rate172800s", MINIMUM),
    ("rate_hold", "3_days", "ge_50__sig172800s__rate259200s", MINIMUM), ("rate_hold", "7_days", "ge_50__sig172800s__rate604800s", MINIMUM),
    ("rate_hold", "10_days", "ge_50__sig172800s__rate864000s", MINIMUM), ("minimum_windows", "5", SELECTED, 5), ("minimum_windows", "10", SELECTED, 10),
    ("minimum_windows", "40", SELECTED, 40), ("minimum_windows", "80", SELECTED, 80),
)


def _text_demographics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("caseid")
    return fx.cases(spark, d).select(
        "caseid", F.when(k % 17 == 0, "NA").otherwise((18 + k % 70).cast("string")).alias("age"), F.when(k % 13 == 0, "x").when(k % 29 == 0, "").when(k % 2 == 0, "m").otherwise("F").alias("sex"),
        F.when(k % 23 == 0, "0").otherwise((150 + k % 40).cast("string")).alias("height"), F.when(k % 19 == 0, "inf").when(k % 31 == 0, "-5").otherwise((45 + k % 60).cast("string")).alias("weight"))


DEMO_CTE = """SELECT caseid, CASE WHEN caseid%17=0 THEN 'missing' ELSE 'value' END AS age_class, 'value' AS height_class, CASE WHEN caseid%19=0 THEN 'invalid' ELSE 'value' END AS weight_class,
  caseid%13<>0 AND caseid%29<>0 AS sex_resolvable, caseid%17<>0 AND caseid%19<>0 AND (caseid%13=0 OR caseid%29<>0) AS all_present, caseid%23<>0 AS height_positive, caseid%19<>0 AND caseid%31<>0 AS weight_positive,
  caseid%17<>0 AND caseid%19<>0 AND caseid%13<>0 AND caseid%29<>0 AND caseid%23<>0 AND caseid%31<>0 AS basic_present FROM cs"""


def demographics(spark: SparkSession, d: str) -> DataFrame:
    return co.demographic_flags(_text_demographics(spark, d))


def frozen(spark: SparkSession, d: str) -> DataFrame:
    c = sweeps.counts(spark, d).where(F.col("candidate_id") == SELECTED)
    k = F.col("caseid")
    inc = fx.cases(spark, d).select("caseid", F.lit(True).alias("included"), (k % 41 == 0).alias("prior"), F.lit(False).alias("exposed"), (F.col("w1") <= F.col("w0")).alias("invalid_window"))
    neg = fx.signal(spark, d).where(F.col("track").isin(fx.RATE_A, fx.RATE_B)).groupBy("caseid").agg(F.count_if(F.col("v") < -15).alias("negative_rates"))
    return co.freeze(c, inc, demographics(spark, d), neg, MINIMUM)


FROZEN_CTE = dict(
    dm=DEMO_CTE, ng="SELECT caseid, count(*) FILTER (WHERE v<-15) AS negative_rates FROM sg WHERE track IN ('RATE_A','RATE_B') GROUP BY 1",
    fz=f"""SELECT caseid, candidate_id, usable_windows, usable_windows>={MINIMUM} AS eligible, CASE WHEN usable_windows>={MINIMUM} THEN 'eligible' ELSE 'ineligible_fewer_than_{MINIMUM}_usable_windows' END AS exclusion_reason,
      all_present AS all_demographics_present, basic_present AS basic_input_feasible, cnt.duplicate_affected>0 AS duplicate_affected, negative_rates>0 AS negative_rate_warning,
      sh AND fail_s>0 AS signal_history_unavailable, sh AND endpoints=0 AS no_candidate_points, sh AND endpoints>0 AND fail_s=endpoints AS no_usable_history, sh AND fail_t>0 AS target_unavailable,
      sh AND endpoints>0 AND fail_t=endpoints AS no_usable_target, sh AND fail_a>0 AS rate_a_unavailable, sh AND fail_b>0 AS rate_b_unavailable, sh AND usable_windows=0 AS zero_windows, sh AS fewer_than_minimum,
      caseid%41=0 AS inherited_exclusion_violated FROM (SELECT *, usable_windows<{MINIMUM} AS sh FROM cnt WHERE candidate_id='{SELECTED}') cnt JOIN dm USING (caseid) JOIN ng USING (caseid)""",
)
FLAGS = ("eligible", "all_demographics_present", "basic_input_feasible", "duplicate_affected", "negative_rate_warning", "signal_history_unavailable", "no_candidate_points", "no_usable_history",
         "target_unavailable", "no_usable_target", "rate_a_unavailable", "rate_b_unavailable", "zero_windows", "fewer_than_minimum", "inherited_exclusion_violated")


def summary(spark: SparkSession, d: str) -> DataFrame:
    return co.summary(frozen(spark, d))


SUMMARY_SQL = sweeps.sweep_sql("SELECT unnest([{'measure':'cases','cases':count(*)::BIGINT}, " + ", ".join(f"{{'measure':'{f}','cases':count(*) FILTER (WHERE {f})::BIGINT}}" for f in FLAGS) + "], recursive:=true) FROM fz", **FROZEN_CTE)


def cohort_ids(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of the eligible and the ineligible ids."""
    return checksums.tree_checksum(frozen(spark, d), "caseid", keys=["eligible"])


IDS_SQL = sweeps.sweep_sql("SELECT k AS eligible, ids, sha256 FROM ct", **FROZEN_CTE, **fx.tree("ct", "fz", "eligible", "caseid", "caseid::VARCHAR"))


def reference(spark: SparkSession, d: str) -> DataFrame:
    return co.sensitivity_reference(sweep.minimum_window_sensitivity(sweeps.counts(spark, d), fx.MIN_WINDOWS), LOOKUPS)


REFERENCE_SQL = sweeps.sweep_sql("SELECT dimension, alternative, candidate_id, minimum, count(*) FILTER (WHERE usable_windows>=minimum)::BIGINT AS eligible_cases FROM (VALUES "
                                 + ",".join(f"('{a}','{b}','{c}',{m}::BIGINT)" for a, b, c, m in LOOKUPS) + ") t(dimension, alternative, candidate_id, minimum) JOIN cnt USING (candidate_id) GROUP BY 1,2,3,4")


def link(spark: SparkSession, d: str) -> DataFrame:
    c = sweeps.counts(spark, d)
    return co.candidate_link(c.where((F.col("caseid") % 10 != 0) | (F.col("rate_cap") < 500000)), fx.cases(spark, d).where("caseid % 3 <> 0"))


LINK_SQL = sweeps.sweep_sql("""SELECT candidate_id, count(*)::BIGINT AS rows, count(*) FILTER (WHERE caseid%3<>0)::BIGINT AS in_cohort, count(*) FILTER (WHERE caseid%3=0)::BIGINT AS outside,
  ((SELECT count(*) FROM cs WHERE caseid%3<>0)-count(*) FILTER (WHERE caseid%3<>0))::BIGINT AS cohort_without_row FROM cnt WHERE caseid%10<>0 OR rate_cap<500000 GROUP BY 1""")


def dry_run(spark: SparkSession, d: str) -> DataFrame:
    from tracksieve.operators.sampling import hash_top

    sample = hash_top(fx.cases(spark, d).select("caseid"), 20260719, 25).select("caseid")
    manifest = fx.cases(spark, d).select("caseid", F.when(F.col("caseid") % 4 == 0, "failed").otherwise("complete").alias("metadata_status"))
    out = co.sample_with_signals(sample, manifest, fx.signal(spark, d))
    entries = F.transform(F.map_entries("track_rows"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("caseid", "metadata_status", F.array_join(entries, "|").alias("track_rows"))


DRY_SQL = fx.sql("""SELECT caseid, CASE WHEN caseid%4=0 THEN 'failed' ELSE 'complete' END AS metadata_status, string_agg(track||'='||n, '|' ORDER BY track) AS track_rows
  FROM (SELECT caseid, track, count(*) AS n FROM sg WHERE caseid IN (SELECT caseid FROM cs ORDER BY sha256('20260719'||chr(0)||caseid), caseid LIMIT 25) GROUP BY 1,2) GROUP BY 1""", "sg", "cs")


def upstream(spark: SparkSession, d: str) -> DataFrame:
    c = sweeps.counts(spark, d).where(F.col("candidate_id") == SELECTED)
    doubled = fx.cases(spark, d).select("caseid").unionByName(fx.cases(spark, d).where("caseid % 7 = 0").select("caseid"))
    return co.upstream_checks({"candidate": c, "cohort": doubled}, {"candidate": {"null_keys": 0, "duplicated_keys": 0}, "cohort": {"duplicated_keys": 0}})


UPSTREAM_SQL = fx.sql("""SELECT *, expected IS NULL OR expected=observed AS ok FROM (SELECT unnest([
  {'table':'candidate','check':'rows','expected':NULL,'observed':n::VARCHAR}, {'table':'candidate','check':'distinct_keys','expected':NULL,'observed':n::VARCHAR}, {'table':'candidate','check':'null_keys','expected':'0','observed':'0'},
  {'table':'candidate','check':'duplicated_keys','expected':'0','observed':'0'}, {'table':'cohort','check':'rows','expected':NULL,'observed':(n+m)::VARCHAR}, {'table':'cohort','check':'distinct_keys','expected':NULL,'observed':n::VARCHAR},
  {'table':'cohort','check':'null_keys','expected':NULL,'observed':'0'}, {'table':'cohort','check':'duplicated_keys','expected':'0','observed':m::VARCHAR}], recursive:=true)
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE caseid%7=0) AS m FROM cs))""", "cs")

QUERIES = {
    "cohort_freeze": Query(frozen, sweeps.sweep_sql("SELECT * FROM fz", **FROZEN_CTE)),
    "cohort_summary": Query(summary, SUMMARY_SQL),
    "cohort_ids": Query(cohort_ids, IDS_SQL),
    "sensitivity_reference": Query(reference, REFERENCE_SQL),
    "demographic_flags": Query(demographics, fx.sql("SELECT * FROM dm", "cs", dm=DEMO_CTE)),
    "candidate_link": Query(link, LINK_SQL),
    "dry_run_join": Query(dry_run, DRY_SQL),
    "upstream_checks": Query(upstream, UPSTREAM_SQL),
}
