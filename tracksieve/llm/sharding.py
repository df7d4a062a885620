"""Sharding into contiguous runs of atomic groups with the smallest largest shard.

Groups are ordered by their 64-bit key.  The smallest capacity for which a greedy
fill needs at most ``shards`` shards is found by binary search, and the greedy fill
at that capacity gives the cuts.

The driver never holds all groups.  It holds the sizes of key ranges: first
``1 << BITS`` ranges of the whole key space, then only the ranges that a cut may fall
into are split again, until the capacity is exact.  With ranges of unknown inside the
greedy fill is bounded from both sides: fills that may only cut between ranges prove
a capacity feasible, fills that may cut anywhere inside an open range prove it
infeasible.  A round returns at most some dozen ranges times ``1 << BITS`` sums.

Cases: a null text counts as an empty one (size 1, CRC 0); equal texts always share a
shard; with fewer groups than shards the last shards stay empty; rows with one id and
text get slots of their own; an empty table gives an empty table; other columns pass
unchanged, and input columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksieve.llm.workspace import stored, table

SHARDS = 8
BITS = 10
SLOT_CELLS = 4096


class Ranges:
    """Sizes of consecutive key ranges; a range is open while it holds more than one group."""

    def __init__(self, first: np.ndarray, bits: np.ndarray, size: np.ndarray, is_open: np.ndarray):
        order = np.argsort(first, kind="stable")
        self.first, self.bits, self.size, self.is_open = first[order], bits[order], size[order], is_open[order]
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.total = int(self.ends[-1])

    def fill(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Lower and upper bounds of the greedy fill's cuts, as sums of sizes."""
        low, high = [0], [0]
        for _ in range(shards):
            low.append(int(self.ends[np.searchsorted(self.ends, low[-1] + capacity, "right") - 1]))
            reach = high[-1] + capacity
            at = int(np.searchsorted(self.ends, reach, "right") - 1)
            high.append(reach if at < len(self.size) and self.is_open[at] else int(self.ends[at]))
        return low, high

    def search(self, shards: int, low: int, high: int) -> tuple[int, int]:
        """The largest capacity known to fail and the smallest known to do; ``low`` fails, ``high`` may be unknown."""
        def smallest(good, a: int, b: int) -> int:
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if good(mid) else (mid, b)
            return b

        fits = smallest(lambda c: self.fill(c, shards)[0][-1] >= self.total, low, max(high, self.total))
        fails = smallest(lambda c: self.fill(c, shards)[1][-1] >= self.total, low, fits) - 1
        return fails, fits


def _sums(groups: DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    rows = groups.groupBy(F.shiftright("_key", 64 - bits).alias("r") if bits < 64 else F.col("_key").alias("r")).agg(
        F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # at most the ranges asked for, see above
    r = np.array([x["r"] for x in rows], dtype=np.int64)
    return r << np.int64(64 - bits) if bits < 64 else r, np.full(len(rows), bits), np.array([x["s"] for x in rows], dtype=np.int64), np.array([x["n"] > 1 for x in rows], dtype=bool)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1, 2, ... and the smallest capacity, from (_key long, _size long), one row a group."""
    found = Ranges(*_sums(groups, BITS))
    if not found.total:
        return [], 0
    low, high = (found.total - 1) // shards, found.total
    while True:
        low, high = found.search(shards, low, high)
        if high - low == 1:
            break
        split = np.zeros(len(found.size), dtype=bool)
        for a, b in zip(found.fill(low + 1, shards)[0][1:], found.fill(high, shards)[1][1:]):
            i, j = np.searchsorted(found.ends, a, "right") - 1, np.searchsorted(found.ends, b, "left")
            split[max(0, i):j + 1] = True
        split &= found.is_open
        if not split.any():
            raise AssertionError("an open capacity needs an open range")
        kept = [x[~split] for x in (found.first, found.bits, found.size, found.is_open)]
        news = []
        for bits in np.unique(found.bits[split]):
            wanted = found.first[split & (found.bits == bits)] >> np.int64(64 - bits)
            inside = groups.filter(F.shiftright("_key", int(64 - bits)).isin([int(x) for x in wanted]))
            news.append(_sums(inside, min(64, int(bits) + BITS)))
        found = Ranges(*[np.concatenate(x) for x in zip(kept, *news)])
    cuts = found.fill(high, shards)[0][1:-1]
    at = np.searchsorted(found.ends, cuts, "right") - 1
    return [int(found.first[i]) for i in at if i < len(found.first)], high


def gapless(df: DataFrame, part: str, ident: str, order: list[str], out: str, cells: int = SLOT_CELLS) -> DataFrame:
    """Number the rows of every part from 0 without a gap; ``cells`` cells per part keep windows small."""
    df = df.withColumn("_cell", F.pmod(F.xxhash64(ident), F.lit(cells)))
    sizes = df.groupBy(part, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(part, "_cell", (F.sum("_n").over(Window.partitionBy(part).orderBy("_cell")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy(part, "_cell").orderBy(*order)) - 1
    return df.withColumn("_here", here).join(before, [part, "_cell"]).withColumn(out, (F.col("_before") + F.col("_here")).cast("bigint")).drop("_cell", "_here", "_before")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_sized(sized: DataFrame, shards: int = SHARDS, ident: str = "doc_id") -> DataFrame:
    """Rows with ``_key`` and ``size`` get ``shard`` and ``slot``; rows of one key stay together."""
    groups = stored(sized.groupBy("_key").agg(F.sum("size").alias("_size")), "groups")
    cuts, _ = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("_key") >= F.lit(c), F.lit(1)).otherwise(F.lit(0)) for c in cuts), F.lit(0))
    return gapless(sized.withColumn("shard", shard.cast("int")), "shard", ident, ["_key", ident], "slot").drop("_key")


def sized_texts(df: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"size": text_size(F.col(text)), "text_crc32": F.crc32(body).cast("bigint"), "_key": F.xxhash64(body)})


def shard_documents(df: DataFrame, shards: int = SHARDS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` with ``size``, ``text_crc32``, ``shard`` and ``slot``; equal texts stay together."""
    return shard_sized(sized_texts(df, text), shards, ident)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = stored(sized_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "items")
    return shard_sized(narrow).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
