"""Quantile and distribution queries on lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions import quantiles as qt
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r


def items(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity",
                                                 F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    long = items(spark, d).select("l_returnflag", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in ("l_extendedprice", "l_quantity", "l_discount")])).alias("_m")).select("l_returnflag", "_m.*")
    return _r(qt.distribution(long, ["l_returnflag", "measure"], "x"))


NEAREST_SQL = " UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS measure, count(x)::BIGINT AS available_count, count(*) FILTER (WHERE x IS NULL)::BIGINT AS missing_count,
  round(min(x),6)+0.0 AS minimum, round(max(x),6)+0.0 AS maximum, """ + ", ".join(f"round(quantile_disc(x,{p}),6)+0.0 AS {n}" for n, p in qt.RECORD_QUANTILES.items())
    + f" FROM (SELECT l_returnflag, CASE WHEN '{c}'='l_discount' AND l_linenumber=3 THEN NULL ELSE {c} END AS x FROM lineitem) GROUP BY 1" for c in ("l_extendedprice", "l_quantity", "l_discount"))


def linear(spark: SparkSession, d: str) -> DataFrame:
    return _r(qt.moments(items(spark, d), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


LINEAR_SQL = """SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(x),6)+0.0 AS mean, round(stddev_samp(x),6)+0.0 AS sd, min(x) AS minimum, max(x) AS maximum,
  round(quantile_cont(x,0.25),6)+0.0 AS q1, round(quantile_cont(x,0.5),6)+0.0 AS median, round(quantile_cont(x,0.75),6)+0.0 AS q3
  FROM (SELECT *, l_extendedprice AS x FROM lineitem) GROUP BY 1,2"""


def p90(spark: SparkSession, d: str) -> DataFrame:
    counts = qt.value_counts(items(spark, d), ["l_returnflag"], "l_extendedprice")
    return qt.quantiles_of_counts(counts, ["l_returnflag"], "l_extendedprice", {"p90": (.9, "rounded")})


P90_SQL = """SELECT l_returnflag, any_value(n)::BIGINT AS n, max(x) FILTER (WHERE r=round_even(0.9*(n-1),0)+1) AS p90 FROM (
  SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1"""


def whole(spark: SparkSession, d: str) -> DataFrame:
    """One group over the whole table: nothing to partition by, still split by value segment."""
    return _r(qt.exact_quantiles(items(spark, d), [], "l_extendedprice", qt.RECORD_QUANTILES))


QUERIES = {
    "dist_nearest_rank": Query(nearest, NEAREST_SQL),
    "dist_linear": Query(linear, LINEAR_SQL),
    "p90_rounded": Query(p90, P90_SQL),
    "dist_whole_table": Query(whole, "SELECT count(*)::BIGINT AS n, " + ", ".join(f"quantile_disc(l_extendedprice,{p}) AS {n}" for n, p in qt.RECORD_QUANTILES.items()) + " FROM lineitem"),
}
