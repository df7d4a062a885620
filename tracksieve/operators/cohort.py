"""Cohort freeze, sensitivity reference, summaries and upstream checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksieve.functions.columns import is_finite, number_class, try_double


def freeze(candidate: DataFrame, included: DataFrame, demographics: DataFrame, quality: DataFrame, minimum: int) -> DataFrame:
    """One row per case of the selected candidate: eligible exactly when windows >= minimum, with contributing reasons.

    ``candidate`` is the sweep output of one candidate; ``included`` (caseid,
    included, prior, exposed, invalid_window), ``demographics`` (caseid,
    all_present, basic_present) and ``quality`` (caseid, negative_rates) have one row per case.
    """
    j = candidate.join(included, "caseid").join(demographics, "caseid").join(quality, "caseid")
    windows, points = F.col("usable_windows"), F.col("endpoints")
    short = windows < minimum

    def why(cond: Column) -> Column:
        return short & cond

    return j.select(
        "caseid", "candidate_id", "usable_windows", (~short).alias("eligible"),
        F.when(short, F.lit(f"ineligible_fewer_than_{minimum}_usable_windows")).otherwise("eligible").alias("exclusion_reason"),
        F.col("all_present").alias("all_demographics_present"), F.col("basic_present").alias("basic_input_feasible"),
        (F.col("duplicate_affected") > 0).alias("duplicate_affected"), (F.col("negative_rates") > 0).alias("negative_rate_warning"),
        why(F.col("fail_s") > 0).alias("signal_history_unavailable"), why(points == 0).alias("no_candidate_points"),
        why((points > 0) & (F.col("fail_s") == points)).alias("no_usable_history"), why(F.col("fail_t") > 0).alias("target_unavailable"),
        why((points > 0) & (F.col("fail_t") == points)).alias("no_usable_target"), why(F.col("fail_a") > 0).alias("rate_a_unavailable"),
        why(F.col("fail_b") > 0).alias("rate_b_unavailable"), why(windows == 0).alias("zero_windows"), short.alias("fewer_than_minimum"),
        (~F.col("included") | F.col("prior") | F.col("exposed") | F.col("invalid_window")).alias("inherited_exclusion_violated"))


def sensitivity_reference(minimum_rows: DataFrame, lookups: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Eligible cases of named alternatives (dimension, alternative, candidate, minimum); a missing one stays null."""
    spark = minimum_rows.sparkSession
    table = spark.createDataFrame(list(lookups), "dimension string, alternative string, candidate_id string, minimum bigint")
    hit = minimum_rows.select("candidate_id", "minimum", F.col("pass_cases").alias("eligible_cases"))
    return table.join(hit, ["candidate_id", "minimum"], "left")


def summary(frozen: DataFrame) -> DataFrame:
    """(measure, cases) over the frozen cohort from one aggregate."""
    flags = [c for c, t in frozen.dtypes if t == "boolean"]
    cells = [F.struct(F.lit("cases").alias("measure"), F.count(F.lit(1)).alias("cases"))]
    cells += [F.struct(F.lit(c).alias("measure"), F.count_if(c).alias("cases")) for c in flags]
    return frozen.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def demographic_flags(rows: DataFrame) -> DataFrame:
    """Per case of text fields age, sex, height, weight: presence, classes, positivity and feasibility."""
    num = {f: try_double(f) for f in ("age", "height", "weight")}
    ok = {f: F.coalesce(is_finite(c), F.lit(False)) for f, c in num.items()}
    sex = F.upper(F.trim("sex"))
    sex_ok = F.coalesce(sex.isin("M", "F"), F.lit(False))
    sex_there = F.coalesce(F.trim("sex") != "", F.lit(False))
    every = ok["age"] & ok["height"] & ok["weight"]
    return rows.select(
        "caseid", *[number_class(f).alias(f"{f}_class") for f in num], sex_ok.alias("sex_resolvable"), (every & sex_there).alias("all_present"),
        (ok["height"] & F.coalesce(num["height"] > 0, F.lit(False))).alias("height_positive"),
        (ok["weight"] & F.coalesce(num["weight"] > 0, F.lit(False))).alias("weight_positive"),
        (every & sex_ok & F.coalesce((num["height"] > 0) & (num["weight"] > 0), F.lit(False))).alias("basic_present"))


def candidate_link(counts: DataFrame, cohort: DataFrame) -> DataFrame:
    """Per candidate: rows, cases in and outside the cohort, and cohort cases without a row."""
    j = counts.select("caseid", "candidate_id").join(cohort.select("caseid", F.lit(True).alias("_in")), "caseid", "left")
    per = j.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("rows"), F.count("_in").alias("in_cohort"), F.count_if(F.col("_in").isNull()).alias("outside"))
    size = cohort.select("caseid").distinct().agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("cohort_without_row", size.scalar() - F.col("in_cohort"))


def sample_with_signals(sample: DataFrame, manifest: DataFrame, signals: DataFrame) -> DataFrame:
    """Sampled cases with their metadata status and the row count of each requested track as one map."""
    counts = signals.join(sample.select("caseid"), "caseid", "left_semi").groupBy("caseid", "track").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("caseid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track", "n")))).alias("track_rows"))  # one entry per track
    return sample.join(manifest, "caseid", "left").join(maps, "caseid", "left")


def upstream_checks(tables: Mapping[str, DataFrame], expected: Mapping[str, Mapping[str, object]], key: str = "caseid") -> DataFrame:
    """(table, check, expected, observed, ok): rows, distinct keys and null keys of every input table."""
    out = None
    for name, df in tables.items():
        per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        cells = {"rows": F.sum("_n"), "distinct_keys": F.count_if(F.col(key).isNotNull()), "null_keys": F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)),
                 "duplicated_keys": F.count_if(F.col("_n") > 1)}
        want = expected.get(name, {})
        rows = per.agg(F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("check"),
                                          F.lit(None if c not in want else str(want[c])).cast("string").alias("expected"), a.cast("string").alias("observed"))
                                 for c, a in cells.items()]).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("ok", F.col("expected").isNull() | (F.col("expected") == F.col("observed")))
