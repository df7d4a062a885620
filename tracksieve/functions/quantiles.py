"""Exact quantiles and distribution records that survive one huge group.

``percentile`` holds a group's distinct values in one task.  Here a group's
values are first counted (equal values collapse map-side), cut into value
segments by a fixed monotone function of the value itself, and the segment that
holds a wanted rank follows from segment totals.  A segment with too many distinct
values is split between its own minimum and maximum, round by round, and only the
part that holds the rank goes on.  Segments of bounded size are ranked in the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.operators.ordered import fits_broadcast
from tracksieve.session import cut_lineage

# The quantiles of a distribution record.
RECORD_QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.50, "q75": 0.75, "q95": 0.95, "q99": 0.99}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

RESOLUTION = 4096  # value segments per doubling of 1 + |value|
SPLITS = 4096  # parts of a segment in one more round
LIMIT = 1 << 16  # distinct values that one task ranks
COUNT = "_c"


def value_segment(value: Column, resolution: float = RESOLUTION) -> Column:
    """Monotone in the value, the same everywhere, and needs no pass over the data."""
    return F.floor(F.signum(value) * F.log2(F.lit(1.0) + F.abs(value)) * F.lit(float(resolution))).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """(keys, value, _c, sums...): how often each value occurs, null included."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(COUNT), *[F.sum(c).alias(n) for n, c in sums.items()])


def _ranks(n: Column, p: float, method: str) -> tuple[Column, Column, Column]:
    """1-based lower rank, upper rank and weight of the upper one."""
    if method == "nearest":
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * n)).cast("bigint")
        return rank, rank, F.lit(0.0)
    if method == "rounded":
        rank = F.bround(F.lit(p) * (n - 1), 0).cast("bigint") + 1
        return rank, rank, F.lit(0.0)
    if method == "linear":
        pos = (n - 1) * F.lit(p)
        return (F.floor(pos) + 1).cast("bigint"), (F.ceil(pos) + 1).cast("bigint"), pos - F.floor(pos)
    raise ValueError(f"unknown quantile method: {method}")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _split(v: Column, lo: Column, hi: Column) -> Column:
    """Part of a segment [lo, hi] with lo < hi that holds v: monotone in v, and lo and hi are always in different parts.

    By sign where the signs differ, else by even widths of the value, or of its logarithm where it spans many doublings.
    """
    last = F.lit(SPLITS - 1)
    even = F.floor((v - lo) / (hi - lo) * last)
    up = F.floor((F.log2(v) - F.log2(lo)) / (F.log2(hi) - F.log2(lo)) * last)
    down = F.floor((F.log2(-lo) - F.log2(-v)) / (F.log2(-lo) - F.log2(-hi)) * last)
    return (
        F.when(F.signum(lo) != F.signum(hi), F.signum(v) + 1)
        .when((lo > 0) & (hi / SPLITS > lo), up).when((hi < 0) & (lo / SPLITS < hi), down).otherwise(even)).cast("bigint")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]], *,
    extra: Sequence[Column] = (), resolution: float = RESOLUTION, limit: int = LIMIT,
) -> DataFrame:
    """One row per group: ``n`` (non-null values), the named quantiles, and ``extra`` aggregates.

    ``counts`` is the output of ``value_counts``; ``wanted`` maps a name to
    (probability, method): ``nearest`` is the observed value at rank ceil(p*n),
    ``linear`` interpolates at position (n-1)*p, ``rounded`` takes the zero-based
    index round(p*(n-1)), half to even.  ``extra`` aggregates over the value rows.

    The segments that hold a wanted rank are split again by their own minimum and
    maximum until none has more than ``limit`` distinct values; then they are ranked.
    """
    keys = list(keys)
    v, c = F.col(value), F.col(COUNT)
    counts = cut_lineage(counts)
    stats = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(v.isNotNull(), c)), F.lit(0)).alias("n"), *extra)
    seen = counts.where(v.isNotNull()).select(*keys, v.cast("double").alias("_v"), COUNT)
    seen = seen.withColumn("_part", value_segment(F.col("_v"), resolution))
    inner = [F.sum(COUNT).alias("_t"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    bounds = {name: _ranks(F.col("_n"), p, m) for name, (p, m) in wanted.items()}
    holds = F.exists(F.array(*[r for lo, hi, _ in bounds.values() for r in (lo, hi)]),
                     lambda r: (r > F.col("_begin")) & (r <= F.col("_begin") + F.col("_t")))
    facts = ["_n", "_begin", "_d", "_lo", "_hi"]

    def targets(parts: DataFrame, by: Sequence[str], total: Column, before: Column) -> DataFrame:
        """The parts with a wanted rank, numbered."""
        order = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.withColumns({"_n": total, "_begin": before + F.coalesce(F.sum("_t").over(order), F.lit(0))})
        return cut_lineage(placed.where(holds).select(*by, "_part", *facts, F.monotonically_increasing_id().alias("_to")))

    aim = targets(seen.groupBy(*keys, "_part").agg(*inner), keys, F.sum("_t").over(Window.partitionBy(*keys)), F.lit(0))
    rows = seen.join(_sized(aim), (seen["_part"] == aim["_part"]) & same_keys(seen, aim, keys)).select(
        *[seen[k] for k in keys], "_v", COUNT, F.col("_to").alias("_at"), *facts)
    while (aim.agg(F.max("_d")).first()[0] or 0) > limit:
        rows = cut_lineage(rows.withColumn("_part", F.when(F.col("_d") > limit, _split(F.col("_v"), F.col("_lo"), F.col("_hi"))).otherwise(0)))
        known = [F.first("_n").alias("_whole"), F.first("_begin").alias("_from")]
        aim = targets(rows.groupBy("_at", "_part").agg(*inner, *known), ["_at"], F.col("_whole"), F.col("_from"))
        rows = rows.join(_sized(aim), (rows["_at"] == aim["_at"]) & (rows["_part"] == aim["_part"])).select(
            *[rows[k] for k in keys], rows["_v"], rows[COUNT], F.col("_to").alias("_at"), *[aim[f] for f in facts])
    inside = Window.partitionBy("_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.select(*keys, "_v", "_n", (F.col("_begin") + F.sum(COUNT).over(inside)).alias("_upto"))
    at = {}
    for name, (lo, hi, w) in bounds.items():
        low, high = (F.min(F.when(F.col("_upto") >= r, F.col("_v"))) for r in (lo, hi))
        at[name] = low if wanted[name][1] != "linear" else low + F.max(w) * (high - low)
    found = ranked.groupBy(*keys).agg(*[x.alias(name) for name, x in at.items()])
    return stats.join(found, same_keys(stats, found, keys), "left").select(
        *[stats[k] for k in keys], *[stats[x] for x in stats.columns if x not in keys], *[found[x] for x in wanted])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *,
    method: str = "nearest", extra: Sequence[Column] = (), resolution: float = RESOLUTION,
) -> DataFrame:
    """Quantiles of raw rows; ``extra`` aggregates see one row per distinct value with its count ``_c``.

    Without ``keys`` the whole table is one group.
    """
    wanted = {name: (p, method) for name, p in probs.items()}
    if not keys:
        one = df.select(F.lit(0).alias("_all"), value)
        return quantiles_of_counts(value_counts(one, ["_all"], value), ["_all"], value, wanted, extra=extra, resolution=resolution).drop("_all")
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, wanted, extra=extra, resolution=resolution)


def distribution(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float] = RECORD_QUANTILES) -> DataFrame:
    """Distribution record of the finite values: available, missing, minimum, nearest-rank quantiles, maximum."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    clean = df.withColumn("_x", F.when(ok, v))
    return exact_quantiles(clean, keys, "_x", probs, extra=[
        F.coalesce(F.sum(F.when(F.col("_x").isNull(), F.col(COUNT))), F.lit(0)).alias("missing_count"),
        F.min("_x").alias("minimum"), F.max("_x").alias("maximum")]).withColumnRenamed("n", "available_count")


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample SD (0 for one value), minimum, quartiles (linear), maximum.

    Mean and SD come straight from the rows: ``avg`` and ``stddev_samp`` combine
    map-side and stay numerically stable.
    """
    keys = list(keys)
    if not keys:
        return moments(df.select(F.lit(0).alias("_all"), value), ["_all"], value).drop("_all")
    q = exact_quantiles(df, keys, value, QUARTILES, method="linear").drop("n")
    s = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return s.join(q, same_keys(s, q, keys)).select(*[s[c] for c in s.columns], *[q[c] for c in QUARTILES])
