"""Inventory queries: eligibility manifest, presence, tasks, funnel, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.operators import inventory as inv
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query

CONCEPTS = {"signal": ("Brand#1", "Brand#2"), "rate_a": ("Brand#3",), "rate_b": ("Brand#4", "Brand#5")}
PENDING = {"quality": ("Brand#6",), "gas": ("Brand#7",)}
NAMES = {"brand_6_present": "Brand#6", "brand_7_present": "Brand#7", "brand_8_present": "Brand#8"}
PRIMARY = tuple(CONCEPTS)


def reg(spark: SparkSession) -> DataFrame:
    return inv.registry(spark, CONCEPTS, PENDING)


def universe(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("caseid"))


def clinical_source(spark: SparkSession, d: str) -> DataFrame:
    """Text rows with missing cases, duplicates and unparsable cells."""
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    s = k.cast("string")
    year = (k % 83)
    base = o.where(k % 37 != 0).select(
        k.alias("caseid"), F.col("o_custkey").cast("string").alias("subjectid"),
        F.when(k % 53 == 0, "abc").when(k % 29 == 0, "NA").otherwise(year.cast("string")).alias("age"),
        F.when(k % 31 == 0, " ").when(k % 2 == 0, "M").otherwise("F").alias("sex"), (150 + k % 50).cast("string").alias("height"),
        F.when(k % 19 == 0, "nan").otherwise((45 + k % 70).cast("string")).alias("weight"), F.lit(None).cast("string").alias("bmi"),
        (1 + k % 6).cast("string").alias("asa"), F.when(F.col("o_orderstatus") == "P", "Spinal").otherwise("General").alias("ane_type"),
        F.col("o_orderpriority").alias("optype"), F.when(k % 3 == 0, "Y").otherwise("N").alias("emop"),
        F.lit("-100").alias("anestart"), F.when(k % 43 == 0, "-200").otherwise(s).alias("aneend"), F.lit("0").alias("opstart"), F.lit("50").alias("opend"))
    return base.unionByName(base.where(F.col("caseid") % 41 == 0))


CLINICAL_CTE = """SELECT o_orderkey AS caseid, o_custkey::VARCHAR AS subjectid,
  CASE WHEN o_orderkey%53=0 THEN 'abc' WHEN o_orderkey%29=0 THEN 'NA' ELSE (o_orderkey%83)::VARCHAR END AS age,
  CASE WHEN o_orderkey%31=0 THEN ' ' WHEN o_orderkey%2=0 THEN 'M' ELSE 'F' END AS sex, (150+o_orderkey%50)::DOUBLE AS height,
  CASE WHEN o_orderkey%19=0 THEN NULL ELSE (45+o_orderkey%70)::DOUBLE END AS weight, (1+o_orderkey%6)::VARCHAR AS asa,
  CASE WHEN o_orderstatus='P' THEN 'Spinal' ELSE 'General' END AS anesthesia_type, o_orderpriority AS operation_type,
  CASE WHEN o_orderkey%3=0 THEN 'Y' ELSE 'N' END AS emergency_status, CASE WHEN o_orderkey%43=0 THEN -200.0 ELSE o_orderkey::DOUBLE END AS anesthesia_end,
  o_orderkey%41=0 AS twice FROM orders WHERE o_orderkey%37<>0"""
_NAMES = {"signal": "'Brand#1','Brand#2'", "rate_a": "'Brand#3'", "rate_b": "'Brand#4','Brand#5'"}
ELIG_CTES = dict(
    cln=CLINICAL_CTE,
    tc="SELECT caseid, " + ", ".join(f"count(*) FILTER (WHERE tname IN ({v})) AS n_{c}" for c, v in _NAMES.items()) + " FROM tk GROUP BY 1",
    e0="""SELECT o_orderkey AS caseid, c.caseid IS NOT NULL AND NOT coalesce(twice,false) AS clinical_available, t.caseid IS NOT NULL AS inventory_available,
      c.caseid IS NOT NULL AND NOT twice AND age<>'abc' AS good, c.caseid IS NULL AS nomd, coalesce(twice,false) AS dupmd, coalesce(age='abc',false) AS bad, c.* EXCLUDE (caseid, twice),
      coalesce(n_signal,0) AS n_signal, coalesce(n_rate_a,0) AS n_rate_a, coalesce(n_rate_b,0) AS n_rate_b
      FROM orders LEFT JOIN cln c ON o_orderkey=c.caseid LEFT JOIN tc t ON o_orderkey=t.caseid""",
    el="""SELECT caseid, clinical_available, inventory_available, CASE WHEN good THEN subjectid END AS subjectid, CASE WHEN good AND age<>'NA' THEN TRY_CAST(age AS DOUBLE) END AS age,
      CASE WHEN good AND trim(sex)<>'' THEN sex END AS sex, CASE WHEN good THEN height END AS height, CASE WHEN good THEN weight END AS weight, CASE WHEN good THEN asa END AS asa,
      CASE WHEN good THEN anesthesia_type END AS anesthesia_type, CASE WHEN good THEN operation_type END AS operation_type, CASE WHEN good THEN emergency_status END AS emergency_status,
      CASE WHEN good THEN anesthesia_end END AS anesthesia_end, good, nomd, dupmd, bad, n_signal, n_rate_a, n_rate_b FROM e0""",
    elig="""SELECT caseid, clinical_available, inventory_available, subjectid, age, sex, height, weight, asa, anesthesia_type, operation_type, emergency_status, anesthesia_end,
      coalesce(age>=18,false) AS adult_candidate, caseid%61=0 AS prior_case, n_signal>0 AS signal_available, n_rate_a>0 AS rate_a_available, n_rate_b>0 AS rate_b_available,
      array_to_string(list_sort(list_filter([CASE WHEN good AND age IS NULL THEN 'age_missing' END, CASE WHEN good AND sex IS NULL THEN 'sex_missing' END,
        CASE WHEN good AND height IS NULL THEN 'height_missing' END, CASE WHEN good AND weight IS NULL THEN 'weight_missing' END,
        CASE WHEN good AND NOT coalesce(age>=18,false) THEN 'adult_criterion_not_met' END, CASE WHEN good AND NOT anesthesia_end>-100 THEN 'time_range_order_invalid_or_missing' END,
        CASE WHEN NOT inventory_available THEN 'track_inventory_missing' END, CASE WHEN caseid%61=0 THEN 'prior_case' END,
        """ + ", ".join(f"CASE WHEN n_{c}=0 THEN '{c}_track_missing' WHEN n_{c}>1 THEN '{c}_track_ambiguous' END" for c in _NAMES) + """], lambda x: x IS NOT NULL)),'|') AS flags,
      concat_ws('|', CASE WHEN nomd THEN 'clinical_metadata_missing' WHEN dupmd THEN 'duplicate_clinical_rows' WHEN bad THEN 'clinical_parse_error:invalid numeric age' END,
        CASE WHEN NOT inventory_available THEN 'track_inventory_missing' END) AS failures FROM el""",
)


def elig_sql(body: str, **more: str) -> str:
    return fx.sql(body, "tk", **ELIG_CTES, **more)


def manifest(spark: SparkSession, d: str) -> DataFrame:
    u = universe(spark, d)
    return inv.eligibility_manifest(u, inv.parse_clinical(clinical_source(spark, d)), fx.tracks(spark, d), reg(spark), PRIMARY, prior=u.where("caseid % 61 = 0"))


SHOWN = ("caseid", "clinical_available", "inventory_available", "subjectid", "age", "sex", "height", "weight", "asa", "anesthesia_type", "operation_type",
         "emergency_status", "anesthesia_end", "adult_candidate", "prior_case", "signal_available", "rate_a_available", "rate_b_available", "audit_status", "failure_type")


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).select(*SHOWN, F.array_join("flags", "|").alias("flags"), F.array_join("failures", "|").alias("failures"))


STATUS = "CASE WHEN failures='' THEN 'complete' ELSE 'failed' END AS audit_status, CASE WHEN failures<>'' THEN split_part(split_part(failures,'|',1),':',1) END AS failure_type"
MISSING = ("age", "sex", "height", "weight", "asa", "subjectid", "anesthesia_type")


def summary(spark: SparkSession, d: str) -> DataFrame:
    return inv.audit_summary(manifest(spark, d), PRIMARY, MISSING)


SUMMARY_SQL = elig_sql("SELECT unnest([" + ", ".join(f"{{'measure':'{n}','cases':{c}::BIGINT}}" for n, c in {
    "records": "count(*)", "audit_complete": "count(*) FILTER (WHERE failures='')", "audit_failed": "count(*) FILTER (WHERE failures<>'')",
    "clinical_available": "count(*) FILTER (WHERE clinical_available)", "inventory_available": "count(*) FILTER (WHERE inventory_available)",
    **{f"missing_{f}": f"count(*) FILTER (WHERE {f} IS NULL)" for f in MISSING},
    **{f"available_{c}": f"count(*) FILTER (WHERE {c}_available)" for c in PRIMARY}}.items()) + "], recursive:=true) FROM elig")


def presence(spark: SparkSession, d: str) -> DataFrame:
    return inv.presence(universe(spark, d), fx.tracks(spark, d), NAMES, {"gas_any": ("brand_7_present", "brand_8_present")})


PRESENCE_CTE = """SELECT o_orderkey AS caseid, coalesce(b6,false) AS brand_6_present, coalesce(b7,false) AS brand_7_present, coalesce(b8,false) AS brand_8_present,
  coalesce(b7 OR b8,false) AS gas_any FROM orders LEFT JOIN (SELECT caseid, bool_or(tname='Brand#6') AS b6, bool_or(tname='Brand#7') AS b7, bool_or(tname='Brand#8') AS b8 FROM tk GROUP BY 1) p ON o_orderkey=caseid"""


def funnel(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d).join(presence(spark, d).select("caseid", "gas_any"), "caseid")
    all_primary = F.col("signal_available") & F.col("rate_a_available") & F.col("rate_b_available")
    return inv.funnel(m, (("exact_primary_tracks", all_primary), ("adult", F.col("adult_candidate")),
                          ("exact_general", F.col("anesthesia_type") == "General"), ("no_candidate_gas_track", ~F.col("gas_any"))))


_F = ["signal_available AND rate_a_available AND rate_b_available", "adult_candidate", "coalesce(anesthesia_type='General',false)", "NOT gas_any"]
_C = ["count(*)"] + ["count(*) FILTER (WHERE " + " AND ".join(_F[:i]) + ")" for i in range(1, 5)]
FUNNEL_SQL = elig_sql("SELECT unnest([" + ", ".join(f"{{'step_no':{i}::INTEGER,'step':'{n}','remaining':{_C[i]}::BIGINT,'lost':({_C[i - 1] if i else _C[0]}-{_C[i]})::BIGINT}}" for i, n in enumerate(
    ("all", "exact_primary_tracks", "adult", "exact_general", "no_candidate_gas_track"))) + "], recursive:=true) FROM elig JOIN pr USING (caseid)", pr=PRESENCE_CTE)


def analysis_universe(spark: SparkSession, d: str) -> DataFrame:
    return inv.analysis_universe(manifest(spark, d), presence(spark, d), PRIMARY)


def pre_quality(spark: SparkSession, d: str) -> DataFrame:
    """Ordered exclusion reasons over the analysis universe; the flags stand for exposure, window and prior use."""
    u = analysis_universe(spark, d)
    p = inv.pre_quality_manifest(u, {"positive_run_long": F.col("gas_any"), "ineligible_invalid_window": F.col("anesthesia_end") <= F.col("anesthesia_start") + 2000,
                                     "prior_overlap": F.col("caseid") % 61 == 0})
    return p.withColumn("reasons", F.array_join("reasons", "|"))


UNIVERSE_WHERE = "WHERE signal_available AND rate_a_available AND rate_b_available AND adult_candidate AND anesthesia_type='General'"


def name_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inv.name_counts(fx.tracks(spark, d))


def unregistered(spark: SparkSession, d: str) -> DataFrame:
    return inv.unregistered_names(fx.tracks(spark, d), reg(spark))


def concept_rows(spark: SparkSession, d: str) -> DataFrame:
    return inv.with_concept(fx.tracks(spark, d), reg(spark)).groupBy("concept", "tname").agg(F.count(F.lit(1)).alias("rows"))


NAME_SQL = "SELECT tname, count(*)::BIGINT AS row_count, count(DISTINCT caseid)::BIGINT AS case_count, count(DISTINCT tid)::BIGINT AS tid_count FROM tk {} GROUP BY 1"
ACTIVE = "'Brand#1','Brand#2','Brand#3','Brand#4','Brand#5'"
TASK_NAMES = ("Brand#3", "Brand#6", "Brand#9", "Brand#24")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return inv.task_matrix(universe(spark, d), fx.tracks(spark, d), TASK_NAMES)


TASK_CTE = """SELECT u.caseid, u.tname, count(DISTINCT tid)::BIGINT AS ids, CASE WHEN count(DISTINCT tid)=1 THEN min(tid) END AS tid,
  CASE count(DISTINCT tid) WHEN 0 THEN 'absent' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status
  FROM (SELECT o_orderkey AS caseid, unnest(['Brand#3','Brand#6','Brand#9','Brand#24']) AS tname FROM orders) u LEFT JOIN tk USING (caseid, tname) GROUP BY 1,2"""


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    t = tasks(spark, d)
    k = F.col("caseid")
    meta = t.where((F.col("status") != "absent") & (k % 9 != 0)).select(
        "caseid", "tname", F.when(k % 7 == 0, "failed").otherwise("complete").alias("status"), (1 + k % 3).alias("attempts"), (k % 1000).alias("bytes"))
    return inv.manifest_rows(t, meta)


MANIFEST_SQL = fx.sql("""SELECT caseid, tname, ids, CASE status WHEN 'absent' THEN 'track_absent' WHEN 'ambiguous' THEN 'ambiguous_multiple_tids'
   ELSE CASE WHEN caseid%9=0 THEN 'not_completed' WHEN caseid%7=0 THEN 'failed' ELSE 'complete' END END AS download_status,
  CASE WHEN status='ok' AND caseid%9<>0 THEN 1+caseid%3 ELSE 0 END::BIGINT AS attempts, CASE WHEN status='ok' AND caseid%9<>0 THEN caseid%1000 ELSE 0 END::BIGINT AS bytes FROM ts""", "tk", ts=TASK_CTE)


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d).join(presence(spark, d).select("caseid", "gas_any"), "caseid")
    return inv.crosstab(m, {"anesthesia_type": F.col("anesthesia_type"), "adult_candidate": inv.encoded("adult", "adult_candidate"),
                            "gas_any": inv.encoded("flag", "gas_any"), "signal": inv.encoded("flag", "signal_available")})


CROSSTAB_SQL = elig_sql("""SELECT 'anesthesia_type='||coalesce(nullif(anesthesia_type,''),'<missing>')||'|adult_candidate='||CASE WHEN adult_candidate THEN 'adult_age_ge_18' ELSE 'not_adult_age_lt_18' END
  ||'|gas_any='||gas_any::INT||'|signal='||signal_available::INT AS combination, count(*)::BIGINT AS cases FROM elig JOIN pr USING (caseid) GROUP BY 1""", pr=PRESENCE_CTE)


def frequency(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d)
    parts = [inv.frequency(m, c).withColumn("field", F.lit(c)) for c in ("anesthesia_type", "operation_type", "sex")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FREQUENCY_SQL = elig_sql(" UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(nullif({c},''),'<missing>') AS value, count(*)::BIGINT AS cases FROM elig GROUP BY 2" for c in ("anesthesia_type", "operation_type", "sex")))

QUERIES = {
    "eligibility_manifest": Query(eligibility, elig_sql(f"SELECT *, {STATUS} FROM elig")),
    "audit_summary": Query(summary, SUMMARY_SQL),
    "presence_pivot": Query(presence, fx.sql("SELECT * FROM pr", "tk", pr=PRESENCE_CTE)),
    "exclusion_funnel": Query(funnel, FUNNEL_SQL),
    "analysis_universe": Query(analysis_universe, elig_sql(f"SELECT caseid, -100.0::DOUBLE AS anesthesia_start, anesthesia_end, pr.* EXCLUDE (caseid) FROM elig JOIN pr USING (caseid) {UNIVERSE_WHERE}", pr=PRESENCE_CTE)),
    "pre_quality_manifest": Query(pre_quality, elig_sql(f"""SELECT *, reasons='' AS included FROM (SELECT caseid, concat_ws('|', CASE WHEN gas_any THEN 'positive_run_long' END,
      CASE WHEN anesthesia_end<=1900 THEN 'ineligible_invalid_window' END, CASE WHEN caseid%61=0 THEN 'prior_overlap' END) AS reasons FROM elig JOIN pr USING (caseid) {UNIVERSE_WHERE})""", pr=PRESENCE_CTE)),
    "name_inventory": Query(name_inventory, fx.sql(NAME_SQL.format(""), "tk")),
    "unregistered_names": Query(unregistered, fx.sql(NAME_SQL.format(f"WHERE tname NOT IN ({ACTIVE})"), "tk")),
    "concept_rows": Query(concept_rows, fx.sql(f"""SELECT CASE WHEN tname IN ('Brand#1','Brand#2') THEN 'signal' WHEN tname='Brand#3' THEN 'rate_a' ELSE 'rate_b' END AS concept,
      tname, count(*)::BIGINT AS rows FROM tk WHERE tname IN ({ACTIVE}) GROUP BY 1,2""", "tk")),
    "task_matrix": Query(tasks, fx.sql("SELECT * FROM ts", "tk", ts=TASK_CTE)),
    "manifest_rows": Query(manifest_rows, MANIFEST_SQL),
    "crosstab": Query(crosstab, CROSSTAB_SQL),
    "frequency": Query(frequency, FREQUENCY_SQL),
}
