"""Episode metrics, paired contrasts and subject-level inference.

Resampling uses portable hash draws and vectors of replicates that add up, so results
are reproducible on any cluster size and every (metric, contrast) shares one set of draws.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.functions.columns import is_finite
from tracksieve.functions.quantiles import moments
from tracksieve.operators.ordered import SPAN, previous_row, segmented
from tracksieve.operators.resampling import interpolated, poisson_counts, replicate_vectors, signs

# Conditions and the weights of the five contrasts (P0S0, P1S0, P0S1, P1S1).
CONDITIONS = ("P0S0", "P1S0", "P0S1", "P1S1")
CONTRASTS = {
    "P1S0_minus_P0S0": (-1.0, 1.0, 0.0, 0.0), "P1S1_minus_P0S1": (0.0, 0.0, -1.0, 1.0), "P0S1_minus_P0S0": (-1.0, 0.0, 1.0, 0.0),
    "P1S1_minus_P1S0": (0.0, -1.0, 0.0, 1.0), "interaction": (1.0, -1.0, -1.0, 1.0)}
# Order in which the four terms of a contrast are added.
SUMMATION_ORDER = ("P0S0", "P0S1", "P1S1", "P1S0")
FLIP_SEED = 1 << 32
#: Decimals kept beyond the printed ones when a number becomes text.
NOISE = 5


def episode_metrics(trajectory: DataFrame, step_seconds: float = 10.0, target: float = 50.0, low: float = 40.0, high: float = 60.0,
                    keys: Sequence[str] = ("caseid", "condition_id"), span: int = SPAN) -> DataFrame:
    """Eleven metrics of (step, x, rate, score) rows per case and condition."""
    rows = previous_row(segmented(trajectory, "step", span), keys, "step", ["rate"])
    x, rate = F.col("x"), F.col("rate")
    off = F.abs(x - target)
    n = F.count(F.lit(1))

    def seconds(cond: Column) -> Column:
        return F.count_if(cond) * F.lit(step_seconds)

    amount = F.sum(rate) * step_seconds / 60.0
    return rows.groupBy(*keys).agg(
        n.alias("steps"), F.avg(off).alias("mean_absolute_deviation"), F.sqrt(F.avg((x - target) * (x - target))).alias("root_mean_squared_deviation"),
        seconds(x.between(low, high)).alias("seconds_in_range"), seconds(x < low).alias("seconds_below"), seconds(x > high).alias("seconds_above"),
        (F.sum(off) * step_seconds).alias("integrated_absolute_error"), F.max(off).alias("maximum_absolute_deviation"),
        amount.alias("total_amount"), (amount / (n * step_seconds / 60.0)).alias("mean_rate"),
        F.coalesce(F.avg(F.abs(rate - F.col("prev.rate"))), F.lit(0.0)).alias("mean_absolute_rate_change"), F.sum("score").alias("score_sum"))


def with_failures(metrics: DataFrame, cases: DataFrame, conditions: Sequence[str], failures: DataFrame | None = None) -> DataFrame:
    """Every expected (case, condition): missing episodes keep null metrics and a reason."""
    expected = cases.select("caseid", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition_id"))
    out = expected.join(metrics.withColumn("completed", F.lit(True)), ["caseid", "condition_id"], "left")
    if failures is not None:
        out = out.join(failures.select("caseid", "condition_id", F.col("reason").alias("_why")), ["caseid", "condition_id"], "left")
    done = F.coalesce("completed", F.lit(False))
    why = F.coalesce(F.col("_why"), F.lit("episode_missing")) if failures is not None else F.lit("episode_missing")
    return out.withColumn("completed", done).withColumn("reason", F.when(F.col("completed"), "").otherwise(why)).drop("_why")


def case_contrasts(rows: DataFrame, metrics: Sequence[str], contrasts: Mapping[str, Sequence[float]] = CONTRASTS,
                   conditions: Sequence[str] = CONDITIONS, order: Sequence[str] = SUMMATION_ORDER) -> DataFrame:
    """(caseid, subjectid, metric, contrast, value, reason): every case, metric and contrast has its row.

    A case counts only if each condition has exactly one row with a finite value, there is no
    other condition, and all rows name one subject; else ``value`` is null and ``reason`` names
    the first fault.  Terms are added in a fixed order.
    """
    long = rows.select("caseid", "subjectid", "condition_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select("caseid", "subjectid", "condition_id", "_m.*")
    at = {c: F.col("condition_id") == c for c in conditions}
    wide = long.groupBy("caseid", "metric").agg(
        F.min("subjectid").alias("subjectid"), F.max("subjectid").alias("_last"), F.count_if(F.col("subjectid").isNull()).alias("_nobody"),
        F.count_if(~F.coalesce(F.col("condition_id").isin(*conditions), F.lit(False))).alias("_unknown"), F.count_if(~is_finite("value")).alias("_odd"),
        *[F.count_if(on).alias(f"_n_{c}") for c, on in at.items()], *[F.max(F.when(on, F.col("value"))).alias(c) for c, on in at.items()])
    rows_of = [F.col(f"_n_{c}") for c in conditions]
    reason = (
        F.when(F.col("_nobody") > 0, "subject_missing").when(F.col("subjectid") != F.col("_last"), "several_subjects")
        .when(F.col("_unknown") > 0, "unknown_condition").when(F.greatest(*rows_of) > 1, "duplicate_condition")
        .when(F.least(*rows_of) < 1, "missing_condition").when(F.col("_odd") > 0, "non_finite_value").otherwise(""))
    # The weights are a literal table; each contrast adds its four weighted terms in the given order.
    table = F.array(*[F.struct(F.lit(name).alias("contrast"), *[F.lit(w).alias(f"w_{c}") for c, w in zip(conditions, weights)])
                      for name, weights in contrasts.items()])
    each = wide.select("caseid", "subjectid", "metric", *conditions, reason.alias("reason"), F.explode(table).alias("_w"))
    total = F.col(f"_w.w_{order[0]}") * F.col(order[0])
    for c in order[1:]:
        total = total + F.col(f"_w.w_{c}") * F.col(c)
    return each.select("caseid", "subjectid", "metric", F.col("_w.contrast").alias("contrast"), F.when(F.col("reason") == "", total).alias("value"), "reason")


def subject_contrasts(contrasts: DataFrame) -> DataFrame:
    """Mean of a subject's case contrasts, with the cases that count and those left out; null if none counts."""
    fine = F.col("reason") == ""
    return contrasts.groupBy("subjectid", "metric", "contrast").agg(
        F.avg("value").alias("value"), F.count_if(fine).alias("cases"), F.count_if(~fine).alias("excluded_cases"))


def subject_condition_means(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    long = rows.select("subjectid", "condition_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_m")).select("subjectid", "condition_id", "_m.*")
    return long.groupBy("subjectid", "condition_id", "metric").agg(F.avg("value").alias("value"))


def condition_summary(subject_means: DataFrame) -> DataFrame:
    """Mean, SD, quartiles and extremes over subjects per condition and metric."""
    return moments(subject_means, ["condition_id", "metric"], "value").withColumnRenamed("n", "subjects")


def _by_subject(subject_rows: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per subject and one column ``v<i>`` per (metric, contrast)."""
    return subject_rows.groupBy("subjectid").agg(*[
        F.max(F.when((F.col("metric") == m) & (F.col("contrast") == c), F.col("value"))).alias(f"v{i}") for i, (m, c) in enumerate(names)])


def _named(vectors: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    labels = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("contrast")) for m, c in names])
    return vectors.withColumn("_l", F.get(labels, F.substring("measure", 2, 9).cast("int"))).select("_l.*", "totals", "weights")


def bootstrap_ci(subject_rows: DataFrame, names: Sequence[tuple[str, str]], replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the resampled mean per (metric, contrast).

    A subject enters replicate b a Poisson(1) number of times; a replicate that draws nobody has no mean.
    """
    measures = [f"v{i}" for i in range(len(names))]
    vectors = _named(replicate_vectors(_by_subject(subject_rows, names), measures, poisson_counts, replicates, seed), names)
    means = F.array_sort(F.array_compact(F.zip_with("totals", "weights", lambda t, w: F.when(w > 0, t / w))))
    tail = (1 - level) / 2
    return vectors.withColumn("_m", means).select(
        "metric", "contrast", interpolated("_m", round(tail, 6)).alias("ci_low"), interpolated("_m", round(1 - tail, 6)).alias("ci_high"))


def sign_flip(subject_rows: DataFrame, names: Sequence[tuple[str, str]], replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Two-sided sign-flip p = (exceeding + 1) / (replicates + 1)."""
    measures = [f"v{i}" for i in range(len(names))]
    # Another seed than the bootstrap's, so that the two do not share draws.
    vectors = _named(replicate_vectors(_by_subject(subject_rows, names), measures, signs, replicates, seed + FLIP_SEED), names)
    seen = subject_rows.groupBy("metric", "contrast").agg(F.abs(F.sum("value")).alias("_total"), F.count("value").alias("_n")).where(F.col("_n") > 0)
    # Means of equal magnitude differ by summation order only in the last bits.
    hits = F.size(F.filter("totals", lambda t: F.abs(t) / F.col("_n") >= F.col("_total") / F.col("_n") - F.lit(1e-9)))
    return vectors.join(F.broadcast(seen), ["metric", "contrast"]).select(  # one row per metric and contrast
        "metric", "contrast", ((hits + 1) / F.lit(float(replicates + 1))).alias("p"))


def holm(p_values: DataFrame) -> DataFrame:
    """Step-down adjustment over the contrasts of each metric (a handful of rows per metric)."""
    by = Window.partitionBy("metric")
    rank = F.row_number().over(by.orderBy("p", "contrast"))
    m = F.count(F.lit(1)).over(by)
    r = p_values.withColumn("_r", rank).withColumn("_m", m)
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col("p"))
    return r.withColumn("_s", step).withColumn("adjusted_p", F.max("_s").over(
        by.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m", "_s")


def effect_size(subject_rows: DataFrame) -> DataFrame:
    """Mean, median and standardised mean (null for a vanishing SD) of the subject values."""
    m = moments(subject_rows, ["metric", "contrast"], "value")
    dz = F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd"))
    return m.select("metric", "contrast", F.col("n").alias("subjects"), F.col("mean").alias("mean_difference"), F.col("median").alias("median_difference"), dz.alias("dz"))


def paired_table(subject_rows: DataFrame, names: Sequence[tuple[str, str]], replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Effect size, bootstrap interval, sign-flip p and adjusted p of every metric and contrast."""
    key = ["metric", "contrast"]
    p = holm(sign_flip(subject_rows, names, replicates, seed))
    return effect_size(subject_rows).join(bootstrap_ci(subject_rows, names, replicates, seed), key).join(p, key)


def formatted(table: DataFrame, precisions: Mapping[str, int], columns: Sequence[str], by: str = "metric", default: int = 3) -> DataFrame:
    """Numbers as text with the metric's number of decimals, halves away from zero; null stays empty.

    The last bits of a mean depend on the order of its sum, so a value within ``NOISE`` further
    decimals of a half is that half: the text is the same however the rows were split.
    """
    def fixed(column: str) -> Column:
        text = {d: F.format_string(f"%.{d}f", F.round(F.round(column, d + NOISE), d) + F.lit(0.0)) for d in {default, *precisions.values()}}
        out = text[default]
        for name, d in precisions.items():
            out = F.when(F.col(by) == name, text[d]).otherwise(out)
        return F.when(F.col(column).isNotNull(), out).otherwise("")

    return table.withColumns({c: fixed(c) for c in columns})


def cell(table: DataFrame, value: str, **where: str) -> DataFrame:
    """One value of a result table by its labels."""
    out = table
    for k, v in where.items():
        out = out.where(F.col(k) == v)
    return out.select(value)
