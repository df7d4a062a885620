"""Case-to-subject linkage, cluster summaries and the subject table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.functions import columns as c
from tracksieve.functions.quantiles import exact_quantiles, quantiles_of_counts
from tracksieve.operators.ordered import spread_join


def linkage_manifest(source: DataFrame) -> DataFrame:
    """Cases with subject size and derived groups.

    ``source`` has caseid, subjectid, sex, age, height, weight, asa, emergency, operation.
    """
    sizes = source.groupBy("subjectid").agg(F.count(F.lit(1)).alias("subject_case_count"))
    rows = spread_join(source, sizes, ["subjectid"], "caseid")
    bmi = c.bmi("height", "weight")
    return rows.select(
        "caseid", "subjectid", "subject_case_count", (F.col("subject_case_count") > 1).alias("repeated_subject"),
        F.trim("sex").alias("sex_source"), c.sex_group("sex").alias("sex_group"),
        c.finite("age").alias("age"), c.age_group("age").alias("age_group"),
        c.finite("height").alias("height"), c.finite("weight").alias("weight"), bmi.alias("bmi"), c.bmi_group(bmi).alias("bmi_group"),
        F.trim("asa").alias("asa_source"), c.asa_group("asa").alias("asa_group"), c.emergency_group("emergency").alias("emergency_group"),
        c.text_group("operation").alias("operation_group"))


def cluster_summary(linkage: DataFrame) -> DataFrame:
    """One row per subject: size, distinct source values, ranges, emergency counts."""
    ranges = [x for f in ("age", "height", "weight", "bmi") for x in (
        F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"), (F.max(f) - F.min(f)).alias(f"{f}_range"))]
    return linkage.groupBy("subjectid").agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("sex_source").alias("sex_values"),
        F.array_join(F.array_sort(F.collect_set("sex_group")), ",").alias("sex_groups"),  # at most three groups
        *ranges, F.count_distinct("asa_source").alias("asa_values"), F.count_distinct("operation_group").alias("operation_values"),
        *[F.count_if(F.col("emergency_group") == g).alias(f"{g}_cases") for g in ("emergency", "non_emergency", "missing_or_other")])


def cluster_sizes(linkage: DataFrame) -> DataFrame:
    """Distribution of subject sizes with subject and case shares (one row per distinct size)."""
    sizes = linkage.groupBy("subjectid").agg(F.count(F.lit(1)).alias("cluster_size")).groupBy("cluster_size").agg(
        F.count(F.lit(1)).alias("subjects"))
    whole = Window.partitionBy(F.lit(0))  # over distinct sizes only
    cases = F.col("cluster_size") * F.col("subjects")
    return sizes.select(
        "cluster_size", "subjects", cases.alias("cases"), (F.col("subjects") / F.sum("subjects").over(whole)).alias("subject_share"),
        (cases / F.sum(cases).over(whole)).alias("case_share"))


def cluster_accounting(linkage: DataFrame) -> DataFrame:
    """Totals, size classes and size quantiles (linear), from the distribution of sizes."""
    sizes = cluster_sizes(linkage).select(F.lit(0).alias("_all"), F.col("cluster_size"), F.col("subjects").alias("_c"))
    s, n = F.col("cluster_size"), F.col("_c")

    def total(x, cond=F.lit(True)):
        return F.coalesce(F.sum(F.when(cond, x)), F.lit(0))

    wanted = {k: (p, "linear") for k, p in (("q01", .01), ("q05", .05), ("q25", .25), ("median", .5), ("q75", .75), ("q95", .95), ("q99", .99))}
    return quantiles_of_counts(sizes, ["_all"], "cluster_size", wanted, extra=[
        total(s * n).alias("cases"), total(n, s == 1).alias("one"), total(n, s == 2).alias("two"), total(n, s == 3).alias("three"),
        total(n, s >= 4).alias("four_or_more"), total(n, s > 1).alias("repeated_subjects"), total(s * n, s > 1).alias("repeated_cases"),
        F.max("cluster_size").alias("largest"), (total(s * n, s > 1) / total(s * n)).alias("repeated_share"),
    ]).drop("_all").withColumnRenamed("n", "subjects")


def subject_table(linkage: DataFrame) -> DataFrame:
    """Cases collapsed to subjects: medians, ranges, bands, stratum key and consistency flags."""
    measures = ("age", "height", "weight")
    long = linkage.select("subjectid", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in measures])).alias("_m")).select("subjectid", "_m.*")
    medians = exact_quantiles(long, ["subjectid", "m"], "v", {"median": .5}, method="linear").groupBy("subjectid").agg(*[
        F.max(F.when(F.col("m") == m, F.col("median"))).alias(f"{m}_median") for m in measures])
    base = linkage.groupBy("subjectid").agg(
        F.count(F.lit(1)).alias("subject_case_count"), F.min("subject_case_count").alias("_d0"), F.max("subject_case_count").alias("_d1"),
        F.min("sex_group").alias("sex_group"), F.max("sex_group").alias("_sex"), F.count_distinct("age_group").alias("age_groups"),
        *[x for m in measures for x in (F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))])
    s = base.join(medians, "subjectid")
    age, band = c.age_group("age_median"), c.case_count_band("subject_case_count")
    return s.select(
        "subjectid", "sex_group", "age_median", "height_median", "weight_median",
        *[(F.col(f"{m}_max") - F.col(f"{m}_min")).alias(f"{m}_range") for m in measures],
        age.alias("subject_age_group"), (F.col("age_groups") > 1).alias("age_group_span_warning"),
        "subject_case_count", band.alias("case_count_band"), F.concat_ws("|", "sex_group", age, band).alias("stratum"),
        ((F.col("_d0") == F.col("subject_case_count")) & (F.col("_d1") == F.col("subject_case_count"))).alias("count_consistent"),
        (F.col("sex_group") == F.col("_sex")).alias("sex_consistent"))
