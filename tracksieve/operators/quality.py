"""Case-level quality records, named scenarios, marginal thresholds, category samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.functions.columns import nul_hash
from tracksieve.operators import sequence as sq
from tracksieve.operators.align import common_span

# Criteria of the three named scenarios, as (reason, metric, comparison, threshold).
SCENARIOS = {
    "permissive": (
        ("duration_lt_20m", "duration", ">=", 1200), ("common_span_lt_10m", "common_span", ">=", 600),
        ("share_0_100_lt_80pct", "share_0_100", ">=", 0.80), ("positive_a_lt_1", "positive_a", ">=", 1),
        ("positive_b_lt_1", "positive_b", ">=", 1), ("negative_rate_present", "negative_rates", "<=", 0)),
    "moderate": (
        ("duration_lt_30m", "duration", ">=", 1800), ("common_span_lt_20m", "common_span", ">=", 1200),
        ("share_10_100_lt_80pct", "share_10_100", ">=", 0.80), ("share_ge_50_lt_50pct", "share_ge_50", ">=", 0.50),
        ("positive_a_lt_3", "positive_a", ">=", 3), ("positive_b_lt_3", "positive_b", ">=", 3),
        ("negative_rate_present", "negative_rates", "<=", 0)),
    "strict": (
        ("duration_lt_60m", "duration", ">=", 3600), ("common_span_lt_30m", "common_span", ">=", 1800),
        ("share_10_100_lt_90pct", "share_10_100", ">=", 0.90), ("share_ge_50_lt_80pct", "share_ge_50", ">=", 0.80),
        ("positive_a_lt_3", "positive_a", ">=", 3), ("positive_b_lt_3", "positive_b", ">=", 3),
        ("negative_rate_present", "negative_rates", "<=", 0)),
}


def case_record(signal: DataFrame, cases: DataFrame, sig: str, qual: str, rate_a: str, rate_b: str) -> DataFrame:
    """One quality record per case over its four tracks."""
    primary = (sig, rate_a, rate_b)
    rows = sq.with_previous(sq.rows_of(signal, cases))
    x, track = F.col("x"), F.col("track")
    inn = F.col("t").between(F.col("w0"), F.col("w1"))

    def n(name: str, cond: Column) -> Column:
        return F.count_if((track == name) & inn & cond)

    has = x.isNotNull()
    base = rows.groupBy("caseid").agg(
        n(sig, has).alias("signal_finite"), n(sig, x.between(0, 100)).alias("_0_100"), n(sig, x.between(10, 100)).alias("_10_100"),
        n(qual, has).alias("quality_finite"), *[n(qual, x >= q).alias(f"_ge_{q}") for q in (20, 50, 80)],
        n(rate_a, x > 0).alias("positive_a"), n(rate_b, x > 0).alias("positive_b"),
        (n(rate_a, x < 0) + n(rate_b, x < 0)).alias("negative_rates"),
        (F.count_if(F.col("delta") < 0) > 0).alias("any_negative_interval"))
    dup = rows.groupBy("caseid", "track", "t").agg(F.count(F.lit(1)).alias("_c")).groupBy("caseid").agg(
        (F.max("_c") > 1).alias("any_duplicate"))
    gaps = sq.with_previous(sq.inside(sq.rows_of(signal, cases)).where(track.isin(*primary))).groupBy("caseid").agg(*[
        F.max(F.when((track == name) & (F.col("delta") > 0), F.col("delta"))).alias(f"gap_{name}") for name in primary])
    span = common_span(signal, cases, primary).select("caseid", "w0", "w1", F.when(
        F.col("s0").isNotNull(), F.greatest(F.lit(0.0), F.col("s1") - F.col("s0"))).alias("common_span"))

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.nullif(F.col(whole), F.lit(0))

    duration = F.col("w1") - F.col("w0")
    return span.join(base, "caseid", "left").join(dup, "caseid", "left").join(gaps, "caseid", "left").select(
        "caseid", duration.alias("duration"), "common_span", F.try_divide("common_span", duration).alias("common_ratio"),
        "signal_finite", share("_0_100", "signal_finite").alias("share_0_100"), share("_10_100", "signal_finite").alias("share_10_100"),
        "quality_finite", *[share(f"_ge_{q}", "quality_finite").alias(f"share_ge_{q}") for q in (20, 50, 80)],
        "positive_a", "positive_b", "negative_rates", *[f"gap_{name}" for name in primary], "any_duplicate", "any_negative_interval")


def _holds(metric: str | Column, op: str, threshold: float) -> Column:
    """The comparison; a null metric fails."""
    m = F.col(metric) if isinstance(metric, str) else metric
    t = F.lit(float(threshold))
    test = {">=": m >= t, "<=": m <= t, ">": m > t, "<": m < t}[op]
    return F.coalesce(test, F.lit(False))


def scenario_results(records: DataFrame, scenarios: Mapping[str, Sequence[tuple[str, str, str, float]]]) -> DataFrame:
    """(caseid, scenario, passes, reasons): failed criteria in their declared order."""
    each = F.array(*[F.struct(F.lit(name).alias("scenario"), F.array_compact(F.array(*[
        F.when(~_holds(metric, op, th), F.lit(reason)) for reason, metric, op, th in criteria])).alias("reasons"))
        for name, criteria in scenarios.items()])
    return records.select("caseid", F.explode(each).alias("_s")).select(
        "caseid", "_s.scenario", (F.size("_s.reasons") == 0).alias("passes"), "_s.reasons")


def scenario_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passes").alias("pass_count"), F.count_if(~F.col("passes")).alias("fail_count"),
        F.avg(F.col("passes").cast("double")).alias("pass_fraction"))


def reason_counts(results: DataFrame, by: str = "scenario") -> DataFrame:
    """Individual reasons and whole reason combinations ('PASS' where empty), per scenario."""
    single = results.select(by, F.explode("reasons").alias("reason")).groupBy(by, "reason").agg(
        F.count(F.lit(1)).alias("cases")).withColumn("kind", F.lit("reason"))
    joined = F.array_join("reasons", "|")
    combo = results.groupBy(by, F.when(joined == "", "PASS").otherwise(joined).alias("reason")).agg(
        F.count(F.lit(1)).alias("cases")).withColumn("kind", F.lit("combination"))
    return single.unionByName(combo)


def marginal_sweep(records: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """One row per (category, metric, comparison, threshold): pass / fail / missing and fraction.

    A missing metric fails and is also counted missing.  All rules in one aggregate.
    """
    whole = records.agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.struct(
        F.lit(cat).alias("category"), F.lit(metric).alias("metric"), F.lit(f"{op}{th:g}").alias("threshold"),
        F.count_if(_holds(metric, op, th)).alias("pass_count"), F.count_if(F.col(metric).isNull()).alias("missing_count"))
        for cat, metric, op, th in rules]).alias("_r"))
    return whole.select("_n", F.explode("_r").alias("_r")).select(
        "_r.*", (F.col("_n") - F.col("_r.pass_count")).alias("fail_count"), (F.col("_r.pass_count") / F.col("_n")).alias("pass_fraction"))


def category_samples(records: DataFrame, categories: Mapping[str, Column], seed: int | str, k: int = 5) -> DataFrame:
    """Up to ``k`` ids per category by hash rank, with the category size.

    The rank filter is pushed below the shuffle (window group limit), so a
    category of any size sends at most ``k`` rows per task.
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in categories.items()]))
    members = records.select("caseid", F.explode(names).alias("category"))
    sizes = members.groupBy("category").agg(F.count(F.lit(1)).alias("category_size"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("_h", "caseid"))
    picked = members.withColumn("_h", nul_hash(F.lit(str(seed)), "category", "caseid")).withColumn("_r", rank).where(F.col("_r") <= k)
    return picked.join(F.broadcast(sizes), "category").select("category", "caseid", "category_size")  # one row per category


def category_sizes(records: DataFrame, categories: Mapping[str, Column]) -> DataFrame:
    """Size of every category, empty ones included."""
    one = records.agg(F.array(*[F.struct(F.lit(n).alias("category"), F.count_if(F.coalesce(c, F.lit(False))).alias("cases"))
                                for n, c in categories.items()]).alias("_c"))
    return one.select(F.explode("_c").alias("_c")).select("_c.*")


def pattern_counts(records: DataFrame) -> DataFrame:
    """Which of the two rates is ever positive, with a marker for negative rates."""
    a, b = F.col("positive_a") > 0, F.col("positive_b") > 0
    label = F.when(a & b, "both_positive").when(a, "a_only_positive").when(b, "b_only_positive").otherwise("both_zero_or_nonpositive")
    full = F.when(F.col("negative_rates") > 0, F.concat(label, F.lit("|negative_rate_present"))).otherwise(label)
    return records.groupBy(full.alias("pattern")).agg(F.count(F.lit(1)).alias("cases"))
