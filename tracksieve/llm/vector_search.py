"""Nearest vectors by largest inner product: multi-probe p-stable hashing.

Vectors get one more component, which turns the largest inner product into the least distance:
``x / M`` (M: the largest norm) is filled up to norm one, a query of norm one gets a zero.  A
table has a few functions ``floor((a.x + b) / w)`` with normal ``a``; equal values of all of
them are a bucket.  Every row is in one bucket of every table.

A query ranks the buckets of all tables by estimated success: the chance that a neighbour lies
there, from normal distributions around the query's own projections.  Slope and spread of a
neighbour's projection are fitted on a sample of at most ``SAMPLE`` vectors; of a large table its
neighbours are farther than the real ones, so more is probed, not less.  Probes go on until
the success of the merged tables reaches ``SUCCESS`` and until enough rows are met, so a query
gets all its rows where there are few.  Vectors without structure need most of the buckets.

Buckets lie in shards of about ``ROWS`` rows; one too large is dealt over several.  A query goes once to
each shard it probes, with the list of its buckets there.  Equal vectors are one entry with
their smallest ids, as later ones cannot be among the nearest, so copies make no large bucket.
Shards keep the best by matrix products and score them again, component by component in order.

Cases: vectors that are null or zero or hold null or non-finite components take no part; shorter
ones are filled up with zeros; rows with the id of the query are its own; null ids are no
queries and come last among ties; other columns are not passed on, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksieve.llm.vector_codes import matrix
from tracksieve.llm.workspace import stored, table

NEIGHBOURS = 20
EVERY = 20
TABLES = 2
SUCCESS = 0.95
#: Vectors the spread of neighbours is fitted on, and queries among them.
SAMPLE, ASKED = 2048, 256
#: Rows a bucket should hold, functions of a table at most, and cells on either side of the middle one.
BUCKET, FUNCTIONS, SIDE = 512, 5, 4
#: Rows of a shard, queries that meet it at once, numbers in one matrix.
ROWS, BLOCK, MATRIX = 1 << 14, 1 << 16, 1 << 20


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


@dataclass(frozen=True)
class Hashes:
    """Functions of all tables; arrays are (table, function[, component])."""

    largest: float
    lines: np.ndarray
    width: np.ndarray
    offset: np.ndarray
    middle: np.ndarray
    slope: float
    shift: np.ndarray
    spread: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows."""
        x = x / self.largest
        return self._project(x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0)))

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Projections of queries."""
        return self._project(x / _norms(x)[:, None], np.zeros(len(x)))

    def _project(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tfd->tnf", x, self.lines[:, :, :-1]) + last[None, :, None] * self.lines[:, None, :, -1]

    def buckets(self, projected: np.ndarray) -> np.ndarray:
        """(table, row): the bucket of each row; the outer cells reach to infinity."""
        cell = np.floor((projected + self.offset[:, None]) / self.width[:, None]) - self.middle[:, None]
        cell = np.clip(cell, -SIDE, SIDE).astype(np.int64) + SIDE
        return (cell * (2 * SIDE + 1) ** np.arange(cell.shape[2])).sum(axis=2)

    def chances(self, projected: np.ndarray, t: int, buckets: np.ndarray) -> np.ndarray:
        """(query, bucket): the chance that a neighbour of the query lies in each bucket of table ``t``."""
        base = 2 * SIDE + 1
        out = np.ones((projected.shape[1], len(buckets)))
        for f in range(projected.shape[2]):
            edges = (np.arange(-SIDE + 1, SIDE + 1) + self.middle[t, f]) * self.width[t, f] - self.offset[t, f]
            far = (edges[None, :] - self.shift[t, f] - self.slope * projected[t, :, f][:, None]) / (self.spread[t, f] * math.sqrt(2))
            below = 0.5 + 0.5 * _erf(far)
            own = np.diff(below, axis=1, prepend=0.0, append=1.0)
            out *= own[:, buckets // base ** f % base]
        total = out.sum(axis=1, keepdims=True)
        return np.where(total > 0, out / np.where(total > 0, total, 1), 1 / max(len(buckets), 1))


_erf = np.vectorize(math.erf, otypes=[float])


def fit(sample: np.ndarray, rows: int, largest: float, neighbours: int = NEIGHBOURS, tables: int = TABLES, seed: int = 2) -> Hashes:
    """Functions for ``rows`` rows: widths are the spread of the sample's projections, so the number of functions sets the buckets."""
    functions = min(max(round(math.log(max(rows / BUCKET, 1), 4)), 1), FUNCTIONS)
    made = np.random.default_rng(seed)
    lines = made.normal(size=(tables, functions, sample.shape[1] + 1))
    blank = np.zeros((tables, functions))
    h = Hashes(largest, lines, blank, blank, blank, 0.0, blank, blank)
    there = h.rows(sample)
    width = np.maximum(there.std(axis=1), 1e-6)
    offset = made.uniform(size=width.shape) * width
    asked = sample[:ASKED]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = min(max(math.ceil(neighbours * len(sample) / max(rows, 1)), 1), len(sample) - 1)
    slope, shift, spread = 0.0, there.mean(axis=1), width
    if near > 0:
        best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        x = np.repeat(h.queries(asked), near, axis=1)
        y = there[:, best.ravel()]
        dx, dy = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        slope = float((dx * dy).sum() / max((dx * dx).sum(), 1e-12))
        shift = y.mean(axis=1) - slope * x.mean(axis=1)
        spread = np.maximum(np.sqrt(((dy - slope * dx) ** 2).mean(axis=1)), width / 16)
    return Hashes(largest, lines, width, offset, np.floor((there.mean(axis=1) + offset) / width), slope, shift, spread)


@dataclass(frozen=True)
class Layout:
    """The buckets in use of every table: their rows, first shard and number of shards."""

    buckets: list[np.ndarray]
    counts: list[np.ndarray]
    first: list[np.ndarray]
    parts: list[np.ndarray]


def layout(found: list[tuple[int, int, int]], tables: int, rows: int) -> Layout:
    """Neighbouring buckets share a shard up to ``rows`` rows; a larger one has shards of its own."""
    out, shard = Layout([], [], [], []), 0
    for t in range(tables):
        own = sorted((b, n) for k, b, n in found if k == t)
        first, parts, held = [], [], 0
        for _, n in own:
            if held and held + n > rows:
                shard, held = shard + 1, 0
            first.append(shard)
            parts.append(-(-n // rows))
            held += n
            if held >= rows:
                shard, held = shard + parts[-1], 0
        shard += 1
        out.buckets.append(np.array([b for b, _ in own], dtype=np.int64))
        out.counts.append(np.array([n for _, n in own], dtype=np.int64))
        out.first.append(np.array(first, dtype=np.int64))
        out.parts.append(np.array(parts, dtype=np.int64))
    return out


def probes(h: Hashes, shape: Layout, projected: np.ndarray, success: float, least: int) -> np.ndarray:
    """(query, probe): whether each bucket of all tables, one table after the other, is probed."""
    owner = np.repeat(np.arange(len(shape.buckets)), [len(b) for b in shape.buckets])
    chance = np.concatenate([h.chances(projected, t, b) for t, b in enumerate(shape.buckets)], axis=1)
    ranked = np.argsort(-chance, axis=1, kind="stable")
    sorted_chance, sorted_owner, rows = np.take_along_axis(chance, ranked, axis=1), owner[ranked], np.concatenate(shape.counts)[ranked]
    missed, met = np.ones(ranked.shape), np.zeros(ranked.shape)
    for t in range(len(shape.buckets)):
        mine = sorted_owner == t
        missed *= 1 - np.cumsum(np.where(mine, sorted_chance, 0), axis=1)
        met = np.maximum(met, np.cumsum(np.where(mine, rows, 0), axis=1))
    enough = (missed <= 1 - success) & (met >= min(least, int(shape.counts[0].sum())))
    enough[:, -1] = True
    last = enough.argmax(axis=1)
    out = np.zeros(ranked.shape, dtype=bool)
    np.put_along_axis(out, ranked, np.arange(ranked.shape[1])[None, :] <= last[:, None], axis=1)
    return out


def _best(keep: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``keep`` of every group."""
    at = np.lexsort((*reversed(order), group))
    own = group[at]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    return at[place < keep]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components, whatever the batch."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _in_bucket(q: np.ndarray, x: np.ndarray, keep: int, none: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``keep`` best rows of each query."""
    step = max(1, MATRIX // max(len(x), x.shape[1], 1))
    out = []
    for start in range(0, len(q), step):
        own = q[start:start + step]
        near = own @ x.T
        if len(x) > keep:
            slack = 1e-12 * _norms(own)[:, None] * _norms(x).max()
            near = near >= -np.partition(-near, keep - 1, axis=1)[:, keep - 1:keep] - slack
        else:
            near = np.ones(near.shape, dtype=bool)
        qi, ri = np.nonzero(near)
        score = np.concatenate([_exact(own[qi[i:i + MATRIX // 16]], x[ri[i:i + MATRIX // 16]]) for i in range(0, len(qi), MATRIX // 16)])
        at = _best(keep, qi, -score, none[ri], ident[ri])
        out.append((qi[at] + start, ri[at], score[at]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    whole = lists.combine_chunks()
    sizes = np.diff(whole.offsets.to_numpy())
    return np.concatenate([[0], np.cumsum(sizes)]), whole.flatten()


def vector_search(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", neighbours: int = NEIGHBOURS, every: int = EVERY,
                  success: float = SUCCESS, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.where(F.col(vector).isNotNull() & fine).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector"))
    # Of equal vectors only the smallest ids can be among the nearest; one more than asked for, as one may be the query's own.
    nth = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last()))
    index = stored(rows.withColumn("_n", nth).where(F.col("_n") <= neighbours + 1).groupBy("vector").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id")))).alias("ids")).withColumn("key", F.xxhash64("vector")), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, long, largest = index.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.sqrt(F.max(squares))).first()
    if not n:
        return spark.createDataFrame([], kind)
    first = index.orderBy("key").limit(SAMPLE).select("vector").collect()  # bounded sample
    sample = np.zeros((len(first), long))
    for i, row in enumerate(first):
        sample[i, :len(row["vector"])] = row["vector"]
    h = fit(sample, n, largest, neighbours, tables)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = h.buckets(h.rows(matrix(batch.column("vector"), long)))
            rest = [batch.column(c) for c in ("key", "vector", "ids")]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, dtype=np.int32)), pa.array(found[t]), *rest], ["table", "bucket", "key", "vector", "ids"])

    kinds = dict(index.dtypes)
    placed = index.mapInArrow(hashed, f"table int, bucket long, key long, vector {kinds['vector']}, ids {kinds['ids']}")
    # One number for each bucket in use; their number is bounded by the functions.
    shape = layout([tuple(r) for r in placed.groupBy("table", "bucket").count().collect()], tables, ROWS)
    asking = rows.where(F.col("id") % every == 0)
    blocks = -(-asking.count() // BLOCK)
    if not blocks:
        return spark.createDataFrame([], kind)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, bucket, key = (batch.column(c).to_numpy() for c in ("table", "bucket", "key"))
            shard = np.zeros(batch.num_rows, dtype=np.int64)
            for t in range(tables):
                own = which == t
                at = np.searchsorted(shape.buckets[t], bucket[own])
                shard[own] = shape.first[t][at] + key[own] % shape.parts[t][at]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *[batch.column(c) for c in ("bucket", "key", "vector", "ids")]], ["shard", "bucket", "key", "vector", "ids"])

    owner = np.repeat(np.arange(tables), [len(b) for b in shape.buckets])
    codes, start, parts = (np.concatenate(x) for x in (shape.buckets, shape.first, shape.parts))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX // len(codes))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                use = probes(h, shape, h.queries(matrix(batch.column("vector"), long)), success, neighbours + 1)
                who, probe = np.nonzero(use)
                who, probe = np.repeat(who, parts[probe]), np.repeat(probe, parts[probe])
                again = np.arange(len(who)) - np.flatnonzero(np.diff(who * len(codes) + probe, prepend=-1))[np.cumsum(np.diff(who * len(codes) + probe, prepend=-1) != 0) - 1]
                shard = start[probe] + again
                order = np.lexsort((shard, who))
                who, probe, shard = who[order], probe[order], shard[order]
                cut = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(who)).astype(np.int32)), pa.array(codes[probe]))
                rest = batch.take(pa.array(who[cut]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut]), *[rest.column(c) for c in ("block", "id", "key", "vector")], lists], ["shard", "block", "query_id", "query", "vector", "probes"])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    left = placed.mapInArrow(dealt, f"shard long, bucket long, key long, vector {kinds['vector']}, ids {kinds['ids']}").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    right = asking.select(block.alias("block"), "id", F.xxhash64("vector").alias("key"), "vector").mapInArrow(
        asked, f"shard long, block long, query_id long, query long, vector {kinds['vector']}, probes array<long>")
    names = ["query_id", "query", "key", "place", "none", "vec_id", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.float64()]

    def met(entries: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if entries.num_rows and queries.num_rows:
            at, ids = _flat(entries["ids"])
            none, ident = (ids.field(f).to_numpy(zero_copy_only=False) for f in ("none", "id"))
            x, q = (matrix(side["vector"].combine_chunks(), long) for side in (entries, queries))
            bucket = entries["bucket"].to_numpy()
            ends, wanted = _flat(queries["probes"])
            wanted, who = wanted.to_numpy(), np.repeat(np.arange(queries.num_rows), np.diff(ends))
            by, rows_by = np.argsort(wanted, kind="stable"), np.argsort(bucket, kind="stable")
            for b in np.unique(wanted):
                some = who[by[slice(*np.searchsorted(wanted[by], [b, b + 1]))]]
                here = rows_by[slice(*np.searchsorted(bucket[rows_by], [b, b + 1]))]
                if len(here):
                    qi, ri, score = _in_bucket(q[some], x[here], neighbours + 1, none[at[here]], ident[at[here]])
                    found.append((some[qi], here[ri], score))
        if not found:
            return pa.table([pa.array([], t) for t in types], names=names)
        qi, ri, score = (np.concatenate(c) for c in zip(*found))
        best = _best(neighbours + 1, qi, -score, none[at[ri]], ident[at[ri]])
        qi, ri, score = qi[best], ri[best], score[best]
        sizes = np.diff(at)[ri]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        qi, ri, score = (np.repeat(c, sizes) for c in (qi, ri, score))
        each = at[ri] + place
        own = queries["query_id"].to_numpy()[qi]
        other = none[each] | (ident[each] != own)
        qi, ri, score, place, each = (c[other] for c in (qi, ri, score, place, each))
        best = _best(neighbours, qi, -score, none[each], ident[each])
        qi, ri, score, place, each = (c[best] for c in (qi, ri, score, place, each))
        columns = [queries["query_id"].to_numpy()[qi], queries["query"].to_numpy()[qi], entries["key"].to_numpy()[ri], place, none[each], ident[each], score]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        met, "query_id long, query long, key long, place int, none boolean, vec_id long, score double")
    once = pairs.dropDuplicates(["query_id", "query", "key", "place"])  # found in several tables
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "none", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= neighbours).select(
        "query_id", "rank", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; queries are the rows whose vec_id is divisible by 20."""
    return vector_search(table(spark, sf_dir, "embeddings"))
