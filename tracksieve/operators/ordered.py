"""Ordered per-key work on bounded segments.

One key may hold a third of all rows, so a window over a whole key is not an
option.  Rows are cut into segments of the order column (``floor(order / span)``:
at most ``span`` rows for an integer order that is unique within its key), the
window runs inside ``(key, segment)``, and what has to cross a segment border is
carried by a table of one row per ``(key, segment)``.

Joins back to the rows use the key *and* the segment, so the rows keep the one
partitioning the windows already asked for, and no hot key meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksieve.session import cut_lineage

SEG = "_seg"
SPAN = 1 << 20
#: Rows that one task holds where few shuffled bytes become many rows.
TASK_ROWS = 1 << 17


def segment_of(order: str | Column, span: float) -> Column:
    o = F.col(order) if isinstance(order, str) else order
    return F.floor(o / F.lit(span)).cast("bigint")


def segmented(df: DataFrame, order: str, span: float = SPAN) -> DataFrame:
    return df.withColumn(SEG, segment_of(order, span))


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions for ``rows`` rows that come out of a shuffle, so that the rows of a task do not grow with the input.

    Sizes of shuffled bytes do not tell: a mark of a few bytes may become thousands of rows.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def balanced(df: DataFrame, keys: Sequence[str], order: str, rows: int = SPAN, cells: int = 4096, _depth: int = 0) -> DataFrame:
    """Add segments of about ``rows`` rows each, cut where the rows of a key are, for an order of any density.

    Each key's range of ``order`` is cut into ``cells`` even cells, whose counts combine
    map-side; neighbouring cells join up to a segment, and a cell with too many rows is cut
    again within its own range.  Only rows that tie in ``order`` cannot be parted.  Segments are
    numbered by the rows before them, so they ascend with the order.  Keys are not null.
    """
    keys = list(keys)
    cell, start = f"_cell{_depth}", f"_start{_depth}"
    df = cut_lineage(df)  # read by every step below
    ranges = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    if not _depth and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= rows:
        return df.withColumn(SEG, F.lit(0).cast("bigint"))  # every key is one segment
    share = (F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    placed = spread_join(df, ranges, keys, order).withColumn(
        cell, F.when(F.col("_hi") > F.col("_lo"), F.floor(share * F.lit(cells - 1))).otherwise(0).cast("bigint")).drop("_lo", "_hi")
    sizes = placed.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"), (F.min(order) < F.max(order)).alias("_wide"))
    by = Window.partitionBy(*keys).orderBy(cell)
    before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = sizes.select(*keys, cell, before.alias("_before"), ((F.col("_n") > rows) & F.col("_wide")).alias("_crowded"))
    group = F.floor(F.col("_before") / rows)
    opens = F.col("_crowded") | F.coalesce(F.lag("_crowded").over(by) | (F.lag(group).over(by) != group), F.lit(True))
    cuts = cut_lineage(counted.select(*keys, cell, "_crowded", F.when(opens, F.col("_before")).alias("_open")).select(
        *keys, cell, "_crowded", F.last("_open", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(start)))
    found = spread_join(placed, cuts, [*keys, cell], order).drop(cell)
    calm = found.where(~F.col("_crowded")).drop("_crowded").withColumnRenamed(start, SEG)
    if cuts.where("_crowded").isEmpty():
        return calm
    inner = balanced(found.where("_crowded").drop("_crowded"), [*keys, start], order, rows, cells, _depth + 1)
    return calm.unionByName(inner.withColumn(SEG, F.col(start) + F.col(SEG)).drop(start))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size estimate of ``df`` is below the session's broadcast threshold (no job runs)."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")
    limit = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit) if limit != "-1" else -1
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size) <= int(limit)


def attach(df: DataFrame, small: DataFrame, on: Sequence[str], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-``on`` attributes to segmented rows without a hot key meeting in one task.

    A side whose estimated size is below the broadcast threshold is broadcast.
    Otherwise the attributes are spread over the segments that exist
    (``distinct`` combines map-side) and joined on key and segment, which is the
    partitioning the segment windows need anyway.
    """
    if fits_broadcast(small):
        return df.join(F.broadcast(small), list(on), how)
    segs = df.select(*keys, SEG).distinct()
    spread = segs.join(small, list(on), how)
    return df.join(spread, [*keys, SEG], how)


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], by: str | Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join one-row-per-``on`` attributes to rows that may pile up on one key.

    Broadcast below the size threshold; otherwise every key is split into
    ``salts`` parts by the hash of ``by`` and the small side repeated per part.
    """
    if fits_broadcast(small):
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(parts, [*on, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """Add the 1-based rank within a key for rows whose ``_seg`` grows with ``order``.

    Ranks run inside (key, segment) on top of the row counts of the segments before.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*keys, SEG, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, SEG).orderBy(*order))
    return df.withColumn("_local", local).join(offsets, [*keys, SEG]).withColumn(
        out, F.col("_before") + F.col("_local")).drop("_before", "_local")


def hash_segment(hex_hash: str | Column, digits: int = 4) -> Column:
    """Segment of a hexadecimal hash by its leading digits: equal shares, and ordered like the hash."""
    h = F.col(hex_hash) if isinstance(hex_hash, str) else hex_hash
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def previous_row(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], out: str = "prev") -> DataFrame:
    """Add struct ``out`` with ``fields`` of the row before, null on a key's first row."""
    keys = list(keys)
    here = F.struct(*fields)
    rows = df.withColumn(out, F.lag(here).over(Window.partitionBy(*keys, SEG).orderBy(order)))
    last = df.groupBy(*keys, SEG).agg(F.max_by(here, F.col(order)).alias("_last"))
    carry = last.select(*keys, SEG, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SEG)).alias("_carry"))
    return (
        rows.join(carry, [*keys, SEG], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_carry")
    )


def next_row(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], out: str = "next") -> DataFrame:
    """Add struct ``out`` with ``fields`` of the row after, null on a key's last row."""
    keys = list(keys)
    here = F.struct(*fields)
    rows = df.withColumn(out, F.lead(here).over(Window.partitionBy(*keys, SEG).orderBy(order)))
    first = df.groupBy(*keys, SEG).agg(F.min_by(here, F.col(order)).alias("_first"))
    carry = first.select(*keys, SEG, F.lead("_first").over(Window.partitionBy(*keys).orderBy(SEG)).alias("_carry"))
    return (
        rows.join(carry, [*keys, SEG], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_carry")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column], exclusive: bool = False) -> DataFrame:
    """Add running totals over a key: total inside the segment plus the segments before.

    ``exclusive`` leaves the current row out.  Rows that tie on ``order`` are
    taken row by row, so ``order`` should be unique where that matters.
    """
    keys = list(keys)
    local = Window.partitionBy(*keys, SEG).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, SEG).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carry = totals.select(*keys, SEG, *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums])
    rows = df.select("*", *[F.sum(c).over(local).alias(n) for n, c in sums.items()])
    rows = rows.join(carry, [*keys, SEG], "left")
    for n in sums:
        zero = F.lit(0)
        rows = rows.withColumn(n, F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_b_{n}"), zero)).drop(f"_b_{n}")
    return rows


def last_known(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column]) -> DataFrame:
    """Replace each value by the last non-null one at or before the row (forward fill)."""
    keys = list(keys)
    local = Window.partitionBy(*keys, SEG).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys, SEG).agg(*[
        F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"_e_{n}") for n, c in values.items()
    ])
    carry = edges.select(*keys, SEG, *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in values])
    rows = df.select("*", *[F.last(c, ignorenulls=True).over(local).alias(f"_l_{n}") for n, c in values.items()])
    rows = rows.join(carry, [*keys, SEG], "left")
    for n in values:
        rows = rows.withColumn(n, F.coalesce(F.col(f"_l_{n}"), F.col(f"_b_{n}"))).drop(f"_l_{n}", f"_b_{n}")
    return rows


def with_halo(df: DataFrame, index: str, span: int, before: int, after: int) -> DataFrame:
    """Segments of a dense integer index that also hold their neighbours' border rows.

    A row within ``before`` of the next segment or ``after`` of the one before is
    copied there, so frames of that width need no carry.  ``_home`` marks the
    original of each row; keep only those after the frame.
    """
    i = F.col(index)
    home = segment_of(i, span)
    first, last = segment_of(i - after, span), segment_of(i + before, span)
    return (
        df.withColumn(SEG, F.explode(F.sequence(first, last)))
        .withColumn("_home", F.col(SEG) == home)
    )


def dense_rows(df: DataFrame, key: str, first: Column, last: Column, out: str, span: int) -> DataFrame:
    """One row per integer from ``first`` to ``last``; a long range is cut into segments that spread over tasks first."""
    lo, hi = first.cast("bigint"), last.cast("bigint")
    cut = df.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_hi") >= F.col("_lo")).withColumn(
        SEG, F.explode(F.sequence(segment_of("_lo", span), segment_of("_hi", span)))).repartition(key, SEG)
    start, end = F.greatest(F.col("_lo"), F.col(SEG) * span), F.least(F.col("_hi"), F.col(SEG) * span + (span - 1))
    return cut.withColumn(out, F.explode(F.sequence(start, end))).drop("_lo", "_hi", SEG)


def islands(
    df: DataFrame, keys: Sequence[str], order: str, start: Column,
    sums: Mapping[str, Column] | None = None, mins: Mapping[str, Column] | None = None, maxs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Merge consecutive rows into islands; ``start`` opens a new one.

    Pieces are built inside each segment, numbered across segments from a prefix
    sum of starts per segment, and merged with aggregates that combine map-side,
    so an island (or a key) of any size stays distributed.
    """
    keys = list(keys)
    parts = {**{n: (F.sum, c) for n, c in (sums or {}).items()},
             **{n: (F.min, c) for n, c in (mins or {}).items()},
             **{n: (F.max, c) for n, c in (maxs or {}).items()}}
    local = Window.partitionBy(*keys, SEG).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        df.withColumn("_piece", F.sum(start.cast("bigint")).over(local))
        .groupBy(*keys, SEG, "_piece")
        .agg(*[agg(c).alias(n) for n, (agg, c) in parts.items()])
    )
    offsets = (
        pieces.groupBy(*keys, SEG).agg(F.max("_piece").alias("_starts"))
        .select(*keys, SEG, F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        pieces.join(offsets, [*keys, SEG])
        .groupBy(*keys, (F.col("_offset") + F.col("_piece")).alias("island"))
        .agg(*[agg(F.col(n)).alias(n) for n, (agg, _) in parts.items()])
    )
