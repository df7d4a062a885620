"""Resampling with mergeable replicate vectors.

A subject's part in replicate b follows from a hash of (seed, b, subject) alone: a Poisson(1)
number of times in the bootstrap, a sign in the sign flip.  So a partition can add its subjects
to one vector of all replicates per measure, and vectors of partitions add up element by
element in a tree.  No row per subject and replicate exists, nothing is joined, and a result
does not depend on how the subjects are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 32  # partitions whose vectors meet in the first level of the tree
CHUNK = 1 << 21  # draws held at once

# The multipliers and the increment of the 64-bit finalizer behind the draws.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BITS = 53


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def draws(subjects: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(subject, replicate) -> 53 uniform bits."""
    start = _mixed(subjects.astype(np.int64).view(np.uint64) * np.uint64(GOLDEN) + np.uint64(seed))
    step = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    return _mixed(start[:, None] + step[None, :]) >> np.uint64(64 - BITS)


def poisson_thresholds() -> list[int]:
    """floor(2^53 P(N <= k)) for a Poisson(1) number N, up to the last one below 2^53."""
    terms = 30
    e = sum(Fraction(1, factorial(k)) for k in range(terms))
    out, total = [], Fraction(0)
    for k in range(terms):
        total += 1 / (e * factorial(k))
        level = int(total * (1 << BITS))
        if level >= 1 << BITS or out and level == out[-1]:
            break
        out.append(level)
    return out


def poisson_counts(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(poisson_thresholds(), dtype=np.uint64), u, side="right").astype(np.float64)


def signs(u: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * (u & np.uint64(1)).astype(np.float64)


def replicate_vectors(wide: DataFrame, measures: Sequence[str], weights: Callable[[np.ndarray], np.ndarray], replicates: int, seed: int) -> DataFrame:
    """(measure, totals, weights): per measure the weighted sums and the sums of weights of every replicate.

    ``wide`` has ``subjectid`` (a whole number) and one double column per measure; nulls take no part.
    """
    names = list(measures)

    def add(held: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        return more if held is None else held + more

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            subjects = batch.column("subjectid").to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(m).to_numpy(zero_copy_only=False) for m in names])
            step = max(1, CHUNK // replicates)
            for i in range(0, len(subjects), step):
                w = weights(draws(subjects[i:i + step], replicates, seed)).T
                v = values[i:i + step]
                there = ~np.isnan(v)
                held = add(held, np.stack([w @ np.where(there, v, 0.0), w @ there.astype(np.float64)]))
        if held is not None:
            part = TaskContext.get().partitionId()
            for k, m in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([part]), pa.array([held[0, :, k]]), pa.array([held[1, :, k]])], fields)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, m in enumerate(batch.column("measure").to_pylist()):
                both = np.stack([batch.column(c)[i].values.to_numpy() for c in ("totals", "weights")])
                held[m] = add(held.get(m), both)
        for m, both in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([0]), pa.array([both[0]]), pa.array([both[1]])], fields)

    fields = ["measure", "part", "totals", "weights"]
    kind = "measure string, part long, totals array<double>, weights array<double>"
    vectors = wide.select(F.col("subjectid").cast("long"), *names).where(F.col("subjectid").isNotNull()).mapInArrow(partial, kind)
    vectors = vectors.repartition("measure", F.pmod("part", F.lit(FAN))).mapInArrow(merge, kind)
    return vectors.repartition("measure").mapInArrow(merge, kind).drop("part")


def interpolated(sorted_values: str, p: float) -> Column:
    """Linear quantile at position (n - 1) p of an ascending array column."""
    at = F.lit(p) * (F.size(sorted_values) - 1)
    low, high = (F.get(sorted_values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (at - F.floor(at)) * (high - low)
