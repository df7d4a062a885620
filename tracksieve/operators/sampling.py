"""Deterministic hash-rank samples, spread picks, draws with replacement, extrapolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.functions.columns import hash_draw, nul_hash
from tracksieve.operators.ordered import SEG, hash_segment, ranked


def stratified_sample(rows: DataFrame, stratum: str, seed: int | str, k: int, key: str = "caseid") -> DataFrame:
    """Up to ``k`` rows per stratum by hash rank; the rank limit is applied map-side before the shuffle."""
    h = rows.withColumn("_h", nul_hash(F.lit(str(seed)), stratum, key))
    r = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    return h.withColumn("_r", r).where(F.col("_r") <= k).drop("_h", "_r")


def hash_top(rows: DataFrame, seed: int | str, n: int, key: str = "caseid") -> DataFrame:
    """The ``n`` rows with the smallest hash (a top-k, not a full sort)."""
    return rows.withColumn("rank_hash", nul_hash(F.lit(str(seed)), key)).orderBy("rank_hash", key).limit(n)


def extrapolate(sample: DataFrame, population: DataFrame, stratum: str, measures: Sequence[str], overhead: float = 1.20, fixed: float = 50 * 1024 * 1024) -> DataFrame:
    """Per stratum mean of the sample times population, and in total with overhead (stratum null)."""
    means = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
    pop = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("population"))
    per = pop.join(means, stratum).select(stratum, "population", "sampled", *[f"mean_{m}" for m in measures],
                                           *[(F.col(f"mean_{m}") * F.col("population")).alias(f"estimated_{m}") for m in measures])
    total = per.agg(F.sum("population").alias("population"), F.sum("sampled").alias("sampled"),
                    *[F.lit(None).cast("double").alias(f"mean_{m}") for m in measures],
                    *[F.ceil(F.sum(f"estimated_{m}") * overhead + fixed).cast("double").alias(f"estimated_{m}") for m in measures])
    return per.unionByName(total.withColumn(stratum, F.lit(None).cast("string")))


def spread_pick(rows: DataFrame, order: Sequence[str], subject: str, key: str = "caseid") -> DataFrame:
    """First, middle and last row in ``order`` with distinct subjects.

    Each subject is first reduced to its smallest row, so the three rows belong
    to different subjects whenever three subjects exist.  Positions come from a
    rank over value segments of the leading order column.
    """
    from tracksieve.functions.quantiles import value_segment

    one = rows.groupBy(subject).agg(F.min(F.struct(*order, key)).alias("_m")).select(subject, *[F.col(f"_m.{c}").alias(c) for c in (*order, key)])
    seg = one.withColumn("_g", F.lit(0)).withColumn(SEG, value_segment(F.col(order[0]).cast("double")))
    r = ranked(seg, ["_g"], [*order, key], "_rank")
    n = one.agg(F.count(F.lit(1)).alias("n"))
    size = n.scalar()
    at = F.when(F.col("_rank") == 1, "first").when(F.col("_rank") == F.floor((size + 1) / 2), "middle").when(F.col("_rank") == size, "last")
    return r.withColumn("position", at).where(F.col("position").isNotNull()).select("position", subject, *order, key)


def draws_with_replacement(spark, items: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """(draw, key): ``n`` hash draws over the items by rank; the draw number is the order."""
    h = items.select(key).distinct().withColumn("_h", nul_hash(F.lit(str(seed)), key)).withColumn("_g", F.lit(0)).withColumn(SEG, hash_segment("_h"))
    r = ranked(h, ["_g"], ["_h", key], "_rank").select(key, "_rank")
    size = items.select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    d = spark.range(n).withColumnRenamed("id", "draw").withColumn("_rank", hash_draw(F.lit(str(seed)), "draw") % size + 1)
    return d.join(r, "_rank").select("draw", key)
