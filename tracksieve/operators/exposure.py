"""Named exposure definitions over the per-case roll-up, and their agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fourteen definitions, in order, with their thresholds (seconds, proportions).
DURATION_THRESHOLDS = {"D_longest_positive_run_ge_10s": 10, "E_longest_positive_run_ge_30s": 30,
                       "F_longest_positive_run_ge_60s": 60, "G_longest_positive_run_ge_300s": 300}
PROPORTION_THRESHOLDS = {"H_positive_proportion_ge_0_1pct": 0.001, "H_positive_proportion_ge_1pct": 0.01,
                         "H_positive_proportion_ge_5pct": 0.05, "H_positive_proportion_ge_10pct": 0.10}
DEFINITIONS = (
    "A_any_allowed_positive_once", "B_any_agent_specific_positive_once", "C_agent_specific_or_support_positive_once",
    *DURATION_THRESHOLDS, *PROPORTION_THRESHOLDS,
    "I_agent_specific_and_support_positive", "J_agent_specific_only_positive", "K_support_only_positive",
)
# Protocols that name one definition each.
PROTOCOLS = {"conservative": "A_any_allowed_positive_once", "duration-based": "F_longest_positive_run_ge_60s",
             "corroborated": "I_agent_specific_and_support_positive"}

# Histogram bins, label -> half-open [from, to); "zero" is exactly 0.
DURATION_BINS = (("positive_under_10s", 10), ("10_to_under_30s", 30), ("30_to_under_60s", 60), ("60_to_under_300s", 300),
                 ("300_to_under_600s", 600), ("600_to_under_1800s", 1800), ("1800_to_under_3600s", 3600), ("3600s_or_more", None))
PROPORTION_BINS = (("positive_under_0_1pct", .001), ("0_1_to_under_1pct", .01), ("1_to_under_5pct", .05), ("5_to_under_10pct", .10),
                   ("10_to_under_25pct", .25), ("25_to_under_50pct", .50), ("50_to_under_75pct", .75), ("75_to_100pct", None))


def definition_flags(
    rollup: DataFrame, durations: dict[str, float] = DURATION_THRESHOLDS, proportions: dict[str, float] = PROPORTION_THRESHOLDS,
) -> DataFrame:
    """One boolean column per definition next to the roll-up of a case (agent and support groups)."""
    agent, support = F.col("positive_agent"), F.col("positive_support")
    either = agent | support
    flags: dict[str, Column] = {
        "A_any_allowed_positive_once": either, "B_any_agent_specific_positive_once": agent,
        "C_agent_specific_or_support_positive_once": either,
        **{n: F.col("longest_any") >= s for n, s in durations.items()},
        **{n: F.col("proportion_any") >= p for n, p in proportions.items()},
        "I_agent_specific_and_support_positive": agent & support,
        "J_agent_specific_only_positive": agent & ~support, "K_support_only_positive": support & ~agent}
    return rollup.select("*", *[c.alias(n) for n, c in flags.items()])


def definition_summary(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Excluded and retained cases per definition, all from one aggregate."""
    one = flags.agg(F.count(F.lit(1)).alias("_n"), F.array(*[
        F.struct(F.lit(n).alias("definition"), F.count_if(F.col(n)).alias("excluded")) for n in names]).alias("_d"))
    return one.select("_n", F.explode("_d").alias("_d")).select(
        "_d.definition", "_d.excluded", (F.col("_n") - F.col("_d.excluded")).alias("retained"),
        (F.col("_d.excluded") / F.col("_n")).alias("excluded_fraction"))


def combination_results(flags: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per combination of group flags: cases, and excluded cases per definition."""
    key = F.concat_ws("|", *[F.concat(F.lit(f"{g}="), F.col(f"positive_{g}").cast("string")) for g in groups])
    per = flags.groupBy(key.alias("combination")).agg(F.count(F.lit(1)).alias("cases"), F.array(*[
        F.struct(F.lit(n).alias("definition"), F.count_if(F.col(n)).alias("excluded")) for n in names]).alias("_d"))
    return per.select("combination", "cases", F.explode("_d").alias("_d")).select("combination", "cases", "_d.*")


def protocol_rows(summary: DataFrame, protocols: dict[str, str] = PROTOCOLS) -> DataFrame:
    table = F.explode(F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(d).alias("_n")) for p, d in protocols.items()]))
    return summary.select("*", table.alias("_p")).where(F.col("_p._n") == F.col("definition")).select(
        "_p.protocol", "definition", "excluded", "retained")


def histogram(df: DataFrame, value: str, bins: Sequence[tuple[str, float | None]]) -> DataFrame:
    """Fixed-bin counts with empty bins kept: exactly zero first, then half-open bins, the last one open."""
    v = F.col(value)
    cells = [F.struct(F.lit(0).alias("ord"), F.lit("zero").alias("label"), F.count_if(v == 0).alias("cases"))]
    low: float | None = None
    for i, (label, high) in enumerate(bins, 1):
        inside = (v > 0) if low is None else (v >= low)
        if high is not None:
            inside = inside & (v < high)
        cells.append(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.count_if(inside).alias("cases")))
        low = high
    one = df.agg(F.array(*cells).alias("_b"), F.count(v).alias("total"))
    return one.select("total", F.explode("_b").alias("_b")).select("_b.*", "total")
