"""Exposure-definition queries over the per-case roll-up of the evidence tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import r6
from tracksieve.operators import exposure as ex
from tracksieve.operators import sequence as sq
from tracksieve.operators import sweep
from tracksieve.plans import sequences
from tracksieve.plans.registry import Query

# The duration and proportion thresholds at driver-table scale.
DURATIONS = dict(zip(ex.DURATION_THRESHOLDS, (43200, 172800, 432000, 864000)))
PROPORTIONS = dict(zip(ex.PROPORTION_THRESHOLDS, (0.3, 0.5, 0.6, 0.7)))
DURATION_BINS = tuple((label, None if high is None else high * 720) for label, high in ex.DURATION_BINS)


def rollup(spark: SparkSession, d: str) -> DataFrame:
    return sq.case_rollup(sequences.evidence(spark, d), sequences.GROUPS)


def flags(spark: SparkSession, d: str) -> DataFrame:
    return ex.definition_flags(rollup(spark, d), DURATIONS, PROPORTIONS)


_EITHER = "(positive_agent OR positive_support)"
FLAG_SQL = {
    "A_any_allowed_positive_once": _EITHER, "B_any_agent_specific_positive_once": "positive_agent",
    "C_agent_specific_or_support_positive_once": _EITHER,
    **{n: f"longest_any>={s}" for n, s in DURATIONS.items()}, **{n: f"proportion_any>={p}" for n, p in PROPORTIONS.items()},
    "I_agent_specific_and_support_positive": "positive_agent AND positive_support",
    "J_agent_specific_only_positive": "positive_agent AND NOT positive_support", "K_support_only_positive": "positive_support AND NOT positive_agent",
}
CTE = dict(
    **sequences.EVIDENCE_CTES, ru=sequences.ROLLUP_CTE,
    fl=" UNION ALL ".join(f"SELECT caseid, '{n}' AS definition, {c} AS f, positive_agent, positive_support FROM ru" for n, c in FLAG_SQL.items()))


def ex_sql(body: str) -> str:
    return sequences.seq_sql(body, cs="csi", **CTE)


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Long form: (caseid, definition, excluded)."""
    f = flags(spark, d)
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("definition"), F.col(n).alias("excluded")) for n in ex.DEFINITIONS]))
    return f.select("caseid", long.alias("_d")).select("caseid", "_d.*")


def summary(spark: SparkSession, d: str) -> DataFrame:
    return ex.definition_summary(flags(spark, d), ex.DEFINITIONS).withColumn("excluded_fraction", r6("excluded_fraction"))


def disagreement(spark: SparkSession, d: str) -> DataFrame:
    return sweep.disagreement(sweep.pass_masks(flags(spark, d), ex.DEFINITIONS), ex.DEFINITIONS)


def combinations(spark: SparkSession, d: str) -> DataFrame:
    return ex.combination_results(flags(spark, d), ("agent", "support"), ex.DEFINITIONS)


def protocols(spark: SparkSession, d: str) -> DataFrame:
    return ex.protocol_rows(ex.definition_summary(flags(spark, d), ex.DEFINITIONS))


def bins(spark: SparkSession, d: str) -> DataFrame:
    r = rollup(spark, d)
    a = ex.histogram(r, "longest_any", DURATION_BINS).withColumn("measure", F.lit("longest_any"))
    b = ex.histogram(r, "proportion_any", ex.PROPORTION_BINS).withColumn("measure", F.lit("proportion_any"))
    return a.unionByName(b)


def _bin_sql(measure: str, table) -> str:
    parts, low = [f"SELECT 0 AS ord, 'zero' AS label, count(*) FILTER (WHERE {measure}=0)::BIGINT AS cases"], None
    for i, (label, high) in enumerate(table, 1):
        cond = (f"{measure}>0" if low is None else f"{measure}>={low}") + ("" if high is None else f" AND {measure}<{high}")
        parts.append(f"SELECT {i}, '{label}', count(*) FILTER (WHERE {cond})::BIGINT")
        low = high
    return " UNION ALL ".join(f"{p}, count(*)::BIGINT AS total, '{measure}' AS measure FROM ru" for p in parts)


QUERIES = {
    "exposure_definitions": Query(definitions, ex_sql("SELECT caseid, definition, f AS excluded FROM fl")),
    "definition_summary": Query(summary, ex_sql("""SELECT definition, count(*) FILTER (WHERE f)::BIGINT AS excluded, count(*) FILTER (WHERE NOT f)::BIGINT AS retained,
      round(count(*) FILTER (WHERE f)/count(*),6)+0.0 AS excluded_fraction FROM fl GROUP BY 1""")),
    "definition_disagreement": Query(disagreement, ex_sql("""SELECT a.definition AS "left", b.definition AS "right", count(*) FILTER (WHERE a.f<>b.f)::BIGINT AS disagreements
      FROM fl a JOIN fl b USING (caseid) GROUP BY 1,2""")),
    "combination_results": Query(combinations, ex_sql("""SELECT 'agent='||positive_agent||'|support='||positive_support AS combination, definition,
      count(*)::BIGINT AS cases, count(*) FILTER (WHERE f)::BIGINT AS excluded FROM fl GROUP BY 1,2""")),
    "named_protocols": Query(protocols, ex_sql("""SELECT p.protocol, definition, count(*) FILTER (WHERE f)::BIGINT AS excluded, count(*) FILTER (WHERE NOT f)::BIGINT AS retained
      FROM fl JOIN (VALUES """ + ",".join(f"('{p}','{n}')" for p, n in ex.PROTOCOLS.items()) + ") p(protocol, definition) USING (definition) GROUP BY 1,2")),
    "histogram_bins": Query(bins, ex_sql(_bin_sql("longest_any", DURATION_BINS) + " UNION ALL " + _bin_sql("proportion_any", ex.PROPORTION_BINS))),
}
