"""Linkage, split and balance queries on orders and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import AGE_ORDER, COUNT_BAND_ORDER, SEX_ORDER, nul_hash
from tracksieve.operators import checksums, linkage as lk, split as sp
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r
from tracksieve.session import cut_lineage

AGE_SQL = "CASE WHEN {0}<18 THEN 'missing_or_invalid' WHEN {0}<40 THEN '18_to_lt_40' WHEN {0}<60 THEN '40_to_lt_60' WHEN {0}<75 THEN '60_to_lt_75' ELSE 'ge_75' END"
CTE = dict(
    ln=f"""SELECT caseid, subjectid, count(*) OVER (PARTITION BY subjectid)::BIGINT AS subject_case_count, count(*) OVER (PARTITION BY subjectid)>1 AS repeated_subject,
      sex AS sex_source, CASE sex WHEN 'M' THEN 'male' ELSE 'female' END AS sex_group, age, {AGE_SQL.format('age')} AS age_group, height, weight, weight/((height/100)*(height/100)) AS bmi,
      CASE WHEN weight/((height/100)*(height/100))<18.5 THEN 'lt_18_5' WHEN weight/((height/100)*(height/100))<25 THEN '18_5_to_lt_25' WHEN weight/((height/100)*(height/100))<30 THEN '25_to_lt_30' ELSE 'ge_30' END AS bmi_group,
      asa AS asa_source, CASE asa WHEN '1' THEN 'ASA_1' WHEN '2' THEN 'ASA_2' WHEN '3' THEN 'ASA_3' ELSE 'ASA_4_or_higher' END AS asa_group,
      CASE emergency WHEN 'Y' THEN 'emergency' WHEN '0' THEN 'non_emergency' ELSE 'missing_or_other' END AS emergency_group,
      CASE WHEN trim(operation)='' THEN 'missing_or_other' ELSE operation END AS operation_group FROM lk""",
    sb=f"""SELECT *, sex_group||'|'||subject_age_group||'|'||case_count_band AS stratum FROM (SELECT subjectid, min(sex_group) AS sex_group, median(age) AS age_median, median(height) AS height_median, median(weight) AS weight_median,
      max(age)-min(age) AS age_range, max(height)-min(height) AS height_range, max(weight)-min(weight) AS weight_range, {AGE_SQL.format('median(age)')} AS subject_age_group,
      count(DISTINCT age_group)>1 AS age_group_span_warning, count(*)::BIGINT AS subject_case_count,
      CASE WHEN count(*)=1 THEN 'one_case' WHEN count(*)=2 THEN 'two_cases' ELSE 'three_or_more_cases' END AS case_count_band, min(subject_case_count)=count(*) AS count_consistent, min(sex_group)=max(sex_group) AS sex_consistent FROM ln GROUP BY 1)""",
    st="SELECT row_number() OVER (ORDER BY so, ao, bo)::INTEGER AS ord, s||'|'||a||'|'||b AS stratum FROM " + ", ".join(
        "(VALUES " + ",".join(f"('{v}',{i})" for i, v in enumerate(vals)) + f") {n}({n},{n}o)" for n, vals in (("s", SEX_ORDER), ("a", AGE_ORDER), ("b", COUNT_BAND_ORDER))),
    qc="SELECT ord, st.stratum, count(subjectid)::BIGINT AS subjects FROM st LEFT JOIN sb ON st.stratum=sb.stratum GROUP BY 1,2",
    qt="""SELECT ord, stratum, subjects, floor_quota, remainder, (floor_quota+CASE WHEN row_number() OVER (ORDER BY remainder DESC, ord)<=
      (sum(subjects) OVER ())//5-sum(floor_quota) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT *, (subjects//5)::BIGINT AS floor_quota, subjects%5 AS remainder FROM qc)""",
    al="""SELECT subjectid, stratum, rank_hash, within_stratum_rank, quota, CASE WHEN within_stratum_rank<=quota THEN 'test' ELSE 'train' END AS assigned_split FROM (
      SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rank_hash, subjectid)::BIGINT AS within_stratum_rank FROM (
        SELECT subjectid, stratum, sha256('20260720'||chr(0)||stratum||chr(0)||subjectid) AS rank_hash FROM sb)) JOIN qt USING (stratum)""",
    cp="SELECT caseid, lk.subjectid, assigned_split FROM lk LEFT JOIN al ON lk.subjectid=al.subjectid",
)


def subj_sql(body: str, **more: str) -> str:
    return fx.sql(body, "lk", **CTE, **more)


def linkage(spark: SparkSession, d: str) -> DataFrame:
    return lk.linkage_manifest(fx.linkage_source(spark, d))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    return lk.subject_table(linkage(spark, d))


def quotas(spark: SparkSession, d: str) -> DataFrame:
    return sp.hamilton_quotas(sp.stratum_counts(subjects(spark, d)))


def allocation(spark: SparkSession, d: str) -> DataFrame:
    s = cut_lineage(subjects(spark, d))  # one row per subject, read by the quotas and by the ranks
    return sp.allocate(s, sp.hamilton_quotas(sp.stratum_counts(s)))


def case_split(spark: SparkSession, d: str) -> DataFrame:
    return sp.case_split(fx.linkage_source(spark, d), allocation(spark, d))


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(lk.cluster_summary(linkage(spark, d)))


CLUSTER_SQL = subj_sql("""SELECT subjectid, count(*)::BIGINT AS cases, count(DISTINCT sex_source)::BIGINT AS sex_values, array_to_string(list_sort(list(DISTINCT sex_group)),',') AS sex_groups,
  """ + ", ".join(f"round(min({f}),6)+0.0 AS {f}_min, round(max({f}),6)+0.0 AS {f}_max, round(max({f})-min({f}),6)+0.0 AS {f}_range" for f in ("age", "height", "weight", "bmi")) + """,
  count(DISTINCT asa_source)::BIGINT AS asa_values, count(DISTINCT operation_group)::BIGINT AS operation_values, """ + ", ".join(
    f"count(*) FILTER (WHERE emergency_group='{g}')::BIGINT AS {g}_cases" for g in ("emergency", "non_emergency", "missing_or_other")) + " FROM ln GROUP BY 1")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return _r(lk.cluster_sizes(linkage(spark, d)))


SIZES_SQL = subj_sql("""SELECT n AS cluster_size, count(*)::BIGINT AS subjects, (n*count(*))::BIGINT AS cases, round(count(*)/sum(count(*)) OVER (),6)+0.0 AS subject_share,
  round(n*count(*)/sum(n*count(*)) OVER (),6)+0.0 AS case_share FROM (SELECT subjectid, count(*) AS n FROM ln GROUP BY 1) GROUP BY 1""")


def accounting(spark: SparkSession, d: str) -> DataFrame:
    return _r(lk.cluster_accounting(linkage(spark, d)))


ACCOUNTING_SQL = subj_sql("""SELECT count(*)::BIGINT AS subjects, sum(n)::BIGINT AS cases, count(*) FILTER (WHERE n=1)::BIGINT AS one, count(*) FILTER (WHERE n=2)::BIGINT AS two,
  count(*) FILTER (WHERE n=3)::BIGINT AS three, count(*) FILTER (WHERE n>=4)::BIGINT AS four_or_more, count(*) FILTER (WHERE n>1)::BIGINT AS repeated_subjects,
  coalesce(sum(n) FILTER (WHERE n>1),0)::BIGINT AS repeated_cases, max(n)::BIGINT AS largest, round(coalesce(sum(n) FILTER (WHERE n>1),0)/sum(n),6)+0.0 AS repeated_share,
  """ + ", ".join(f"round(quantile_cont(n::DOUBLE,{p}),6)+0.0 AS {k}" for k, p in (("q01", .01), ("q05", .05), ("q25", .25), ("median", .5), ("q75", .75), ("q95", .95), ("q99", .99)))
    + " FROM (SELECT subjectid, count(*) AS n FROM ln GROUP BY 1)")


def targets(spark: SparkSession, d: str) -> DataFrame:
    l = fx.linkage_source(spark, d)
    totals = l.agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("subjectid").alias("subjects")).select(F.explode(F.array(
        F.struct(F.lit("case").alias("unit"), F.col("cases").alias("total")), F.struct(F.lit("subject").alias("unit"), F.col("subjects").alias("total")))).alias("_t")).select("_t.*")
    return _r(sp.largest_remainder(totals))


TARGETS_SQL = subj_sql("""SELECT unit, split, round(ideal,6)+0.0 AS ideal, (f+CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY ideal-f DESC, o)<=total-sum(f) OVER (PARTITION BY unit) THEN 1 ELSE 0 END)::BIGINT AS target
  FROM (SELECT *, total*share AS ideal, floor(total*share)::BIGINT AS f FROM (SELECT 'case' AS unit, count(*) AS total FROM lk UNION ALL SELECT 'subject', count(DISTINCT subjectid) FROM lk),
   (VALUES (0,'train',0.70::DOUBLE),(1,'validation',0.15::DOUBLE),(2,'test',0.15::DOUBLE)) s(o,split,share))""")

CONTINUOUS = ("age_median", "height_median", "weight_median", "subject_case_count")
PRIMARY = ("sex_group", "subject_age_group", "case_count_band")
SECONDARY = ("age_group", "bmi_group", "asa_group", "emergency_group", "operation_group")


def _subjects_with_split(spark: SparkSession, d: str) -> DataFrame:
    s = cut_lineage(subjects(spark, d))
    a = sp.allocate(s, sp.hamilton_quotas(sp.stratum_counts(s)))
    return cut_lineage(s.join(a.select("subjectid", "assigned_split"), "subjectid"))


def _cases_with_split(spark: SparkSession, d: str) -> DataFrame:
    return linkage(spark, d).join(case_split(spark, d).select("caseid", "assigned_split"), "caseid")


def continuous(spark: SparkSession, d: str) -> DataFrame:
    return _r(sp.balance_continuous(_subjects_with_split(spark, d), CONTINUOUS))


def _cont_sql(v: str) -> str:
    cols = []
    for g in ("train", "test"):
        f = f"FILTER (WHERE assigned_split='{g}')"
        cols.append(f"count(*) {f}::BIGINT AS {g}_n, avg(x) {f} AS {g}_mean, coalesce(stddev_samp(x) {f},0) AS {g}_sd, quantile_cont(x,0.25) {f} AS {g}_q1, quantile_cont(x,0.5) {f} AS {g}_median, quantile_cont(x,0.75) {f} AS {g}_q3")
    return f"SELECT '{v}' AS variable, {', '.join(cols)} FROM (SELECT {v}::DOUBLE AS x, assigned_split FROM sb JOIN al USING (subjectid))"


CONT_CTE = dict(ct="SELECT *, (train_mean-test_mean)/sqrt((train_sd*train_sd+test_sd*test_sd)/2) AS smd FROM (" + " UNION ALL ".join(_cont_sql(v) for v in CONTINUOUS) + ")")
CONTINUOUS_SQL = subj_sql("SELECT variable, train_n, test_n, " + ", ".join(f"round({g}_{k},6)+0.0 AS {g}_{k}" for g in ("train", "test") for k in ("mean", "sd", "q1", "median", "q3"))
                          + ", round(smd,6)+0.0 AS smd, CASE WHEN abs(smd)<=0.1 THEN 'acceptable' WHEN abs(smd)<=0.2 THEN 'warning' ELSE 'hard_fail' END AS interpretation FROM ct", **CONT_CTE)


def categorical(spark: SparkSession, d: str) -> DataFrame:
    a = sp.balance_categorical(_subjects_with_split(spark, d), PRIMARY).withColumn("analysis", F.lit("subject_primary"))
    b = sp.balance_categorical(_cases_with_split(spark, d), SECONDARY).withColumn("analysis", F.lit("case_secondary"))
    return _r(a.unionByName(b))


def _cat_sql(analysis: str, v: str, src: str) -> str:
    return f"""SELECT '{analysis}' AS analysis, '{v}' AS variable, {v} AS level, count(*) FILTER (WHERE assigned_split='train')::BIGINT AS train_count, count(*) FILTER (WHERE assigned_split='test')::BIGINT AS test_count FROM {src} GROUP BY 3"""


CAT_CTE = dict(cg="SELECT *, train_count/train_n-test_count/test_n AS df FROM (SELECT *, sum(train_count) OVER (PARTITION BY variable)::BIGINT AS train_n, sum(test_count) OVER (PARTITION BY variable)::BIGINT AS test_n FROM ("
               + " UNION ALL ".join([_cat_sql("subject_primary", v, "(SELECT sb.*, assigned_split FROM sb JOIN al USING (subjectid))") for v in PRIMARY]
                                    + [_cat_sql("case_secondary", v, "(SELECT ln.*, assigned_split FROM ln JOIN cp USING (caseid))") for v in SECONDARY]) + "))")
CATEGORICAL_SQL = subj_sql("""SELECT analysis, variable, level, train_count, test_count, train_n, test_n, round(train_count/train_n,6)+0.0 AS train_proportion, round(test_count/test_n,6)+0.0 AS test_proportion,
  round(df,6)+0.0 AS difference, CASE WHEN abs(df)<=0.05 THEN 'acceptable' ELSE 'warning' END AS interpretation FROM cg""", **CAT_CTE)


def summary(spark: SparkSession, d: str) -> DataFrame:
    s = _subjects_with_split(spark, d)
    return _r(sp.balance_summary(sp.balance_continuous(s, CONTINUOUS), sp.balance_categorical(s, PRIMARY), sp.balance_categorical(_cases_with_split(spark, d), SECONDARY)))


SUMMARY_SQL = subj_sql("""SELECT round(max(abs(smd)),6)+0.0 AS maximum_absolute_smd, count(*) FILTER (WHERE abs(smd)>0.1 AND abs(smd)<=0.2)::BIGINT AS continuous_warnings,
  count(*) FILTER (WHERE abs(smd)>0.2)::BIGINT AS continuous_hard_failures, (SELECT count(*) FROM cg WHERE abs(df)>0.05 AND analysis='subject_primary')::BIGINT AS primary_warnings,
  (SELECT count(*) FROM cg WHERE abs(df)>0.05 AND analysis='case_secondary')::BIGINT AS secondary_warnings, max(abs(smd))<=0.2 AS gate_passed FROM ct""", **CONT_CTE, **CAT_CTE)


def guard(spark: SparkSession, d: str) -> DataFrame:
    """The guard on a contaminated copy, against the seal of the clean one: some cases moved against their subject, some subjects in both splits."""
    a, c = allocation(spark, d), case_split(spark, d)
    flip = F.when(F.col("assigned_split") == "train", "test").otherwise("train")
    bad_cases = c.withColumn("assigned_split", F.when(F.col("caseid") % 40 == 0, flip).otherwise(F.col("assigned_split"))).withColumn(
        "subjectid", F.when(F.col("caseid") % 97 == 0, -F.col("subjectid") - 1).otherwise(F.col("subjectid")))
    s = a.select("subjectid", "assigned_split")
    bad_subjects = s.unionByName(s.where("subjectid % 50 = 0").withColumn("assigned_split", flip))
    seal = {r["assigned_split"]: r["sha256"] for r in checksums.tree_checksum(c, "caseid", keys=["assigned_split"]).collect()}  # one row per split
    return sp.split_guard(bad_cases, bad_subjects, seal)


GUARD_SQL = subj_sql("""SELECT 'subjects_in_two_splits' AS "check", count(*)::BIGINT AS observed FROM al WHERE subjectid%50=0
  UNION ALL SELECT 'cases_in_two_splits', 0 UNION ALL SELECT 'cases_without_parent', count(*) FROM cp WHERE caseid%97=0
  UNION ALL SELECT 'cases_against_parent', count(*) FROM (SELECT CASE WHEN caseid%40=0 THEN CASE assigned_split WHEN 'train' THEN 'test' ELSE 'train' END ELSE assigned_split END AS a,
     CASE WHEN subjectid%50=0 THEN 'test' ELSE assigned_split END AS p FROM cp WHERE caseid%97<>0) WHERE a<>p
  UNION ALL SELECT 'seal_mismatches', count(*) FROM tb LEFT JOIN ta USING (k) WHERE ta.sha256 IS DISTINCT FROM tb.sha256""", **fx.tree("ta", "cp", "assigned_split", "caseid", "caseid::VARCHAR"),
  bc="SELECT caseid, CASE WHEN caseid%40=0 THEN CASE assigned_split WHEN 'train' THEN 'test' ELSE 'train' END ELSE assigned_split END AS assigned_split FROM cp",
  **fx.tree("tb", "bc", "assigned_split", "caseid", "caseid::VARCHAR"))


def id_checksums(spark: SparkSession, d: str) -> DataFrame:
    return checksums.tree_checksum(case_split(spark, d), "caseid", keys=["assigned_split"])


def tree_sql(base: str, body: str, src: str, key: str, number: str, line: str) -> str:
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in fx.tree("tr", src, key, number, line).items())
    return base.rsplit("\n", 1)[0] + ",\n" + ctes + "\n" + body


CHECKSUM_SQL = tree_sql(subj_sql("x"), "SELECT k AS assigned_split, ids, sha256 FROM tr", "cp", "assigned_split", "caseid", "caseid::VARCHAR")


def flat_checksums(spark: SparkSession, d: str) -> DataFrame:
    """The plain checksum of the linkage pairs and of the case ids."""
    l = fx.linkage_source(spark, d)
    pairs = checksums.flat_checksum(l, "caseid", F.concat_ws("\t", F.col("caseid").cast("string"), F.col("subjectid").cast("string"))).withColumn("what", F.lit("pairs"))
    return pairs.unionByName(checksums.flat_checksum(l, "caseid").withColumn("what", F.lit("ids")))


FLAT_SQL = subj_sql("""SELECT 'pairs' AS what, count(*)::BIGINT AS ids, sha256(string_agg(caseid||chr(9)||subjectid, chr(10) ORDER BY caseid)||chr(10)) AS sha256 FROM lk
  UNION ALL SELECT 'ids', count(*)::BIGINT, sha256(string_agg(caseid::VARCHAR, chr(10) ORDER BY caseid)||chr(10)) FROM lk""")


def split_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct test subjects, in numeric order."""
    return allocation(spark, d).where(F.col("assigned_split") == "test").select("subjectid").distinct().orderBy("subjectid")


def feasibility(spark: SparkSession, d: str) -> DataFrame:
    return sp.feasibility(lk.cluster_sizes(linkage(spark, d)))




def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    """Pseudonymous ids from version, seal and case."""
    l = fx.linkage_source(spark, d)
    return l.select("caseid", nul_hash(F.lit("template-v1"), F.lit("seal"), "caseid").alias("template_id"), nul_hash(F.lit("bundle-v1"), F.lit("seal"), "caseid").alias("bundle_id"))


QUERIES = {
    "linkage_manifest": Query(lambda s, d: _r(linkage(s, d)), subj_sql("SELECT * REPLACE (round(age,6)+0.0 AS age, round(bmi,6)+0.0 AS bmi) FROM ln")),
    "cluster_summary": Query(cluster_summary, CLUSTER_SQL),
    "cluster_sizes": Query(sizes, SIZES_SQL),
    "cluster_accounting": Query(accounting, ACCOUNTING_SQL),
    "subject_collapse": Query(lambda s, d: _r(subjects(s, d)), subj_sql("SELECT * REPLACE (round(age_median,6)+0.0 AS age_median, round(age_range,6)+0.0 AS age_range) FROM sb")),
    "targets_largest_remainder": Query(targets, TARGETS_SQL),
    "stratum_counts": Query(lambda s, d: sp.stratum_counts(subjects(s, d)), subj_sql("SELECT * FROM qc")),
    "hamilton_quotas": Query(quotas, subj_sql("SELECT *, subjects-quota AS train_count FROM qt")),
    "split_allocation": Query(allocation, subj_sql("SELECT * FROM al")),
    "case_split": Query(case_split, subj_sql("SELECT * FROM cp")),
    "balance_continuous": Query(continuous, CONTINUOUS_SQL),
    "balance_categorical": Query(categorical, CATEGORICAL_SQL),
    "balance_summary": Query(summary, SUMMARY_SQL),
    "split_guard": Query(guard, GUARD_SQL),
    "id_checksums": Query(id_checksums, CHECKSUM_SQL),
    "flat_checksums": Query(flat_checksums, FLAT_SQL),
    "split_ids": Query(split_ids, subj_sql("SELECT DISTINCT subjectid FROM al WHERE assigned_split='test'")),
    "split_feasibility": Query(feasibility, None),
    "derived_ids": Query(derived_ids, fx.sql("""SELECT caseid, sha256('template-v1'||chr(0)||'seal'||chr(0)||caseid) AS template_id, sha256('bundle-v1'||chr(0)||'seal'||chr(0)||caseid) AS bundle_id FROM lk""", "lk")),
}
