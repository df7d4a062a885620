"""Vector code compression: product codes by exact integer k-means, with products split into limbs.

Components become integers ``floor(scale * x)`` and vectors are cut into ``parts`` equal parts,
each with a codebook of ``entries`` entries.  A round assigns every part to its nearest entry
(squared distance, ties to the lower index) and replaces each entry by the floor of the mean of
its parts; unused entries stay.

Distances are ``|a|^2 - 2 a.c + |c|^2``.  The products come from float64 matrix multiplication:
integers are broken into limbs so small that every sum of products stays below 2^53 and is
exact, and the limbs' products are put together in int64.  Vectors too large for int64 take
Python's integers instead.  So results do not depend on batches, partitions or machines.

A round is one scan: tasks assign their rows and send sums and counts of the entries in use,
which Spark adds up.  The driver holds codebooks only (``entries`` x dimension numbers).

Cases: rows whose vector is null or holds a component that is null, not finite or beyond the
float range take no part; vectors of unequal length, or of a length that ``parts`` does not
divide, are filled up with zeros; fewer than ``entries`` rows give that many entries; null ids
come last and rows with one id are ordered by vector; a null label is a label of its own; an
error beyond the long range is null, and so is the sum over its label; no row left gives an
empty table; other columns are not passed on, so none can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import attach, stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components at or beyond this (the float range) count as not finite.
RANGE = 2.0 ** 128
#: Numbers in one distance matrix.
MATRIX = 1 << 21
#: Sums travel as two decimals, below and above this bit.
SPLIT_BIT = 100


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """x = sum of limb i << (i * width); all limbs are within 2^width, the last one is signed."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << width:
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All dot products of the rows of ``a`` and ``c`` in int64, exact if they fit there."""
    width = (53 - max(a.shape[1] - 1, 1).bit_length()) // 2
    out = np.zeros((len(a), len(c)), dtype=np.int64)
    right = limbs(c, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (width * (i + j))
    return out


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where every number is below 2^52, else Python integers."""
    scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0 ** 52:
        return scaled.astype(np.int64)
    flat = [math.floor(v * scale) if abs(v) < 2.0 ** 900 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(len(flat), dtype=object)
    out[:] = flat
    return out.reshape(x.shape)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def nearest(a: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of every row; the first of equal ones."""
    if a.shape[1] * (_largest(a) + _largest(book)) ** 2 < 1 << 62:
        a, book = a.astype(np.int64), book.astype(np.int64)
        far = (a * a).sum(axis=1)[:, None] - 2 * products(a, book) + (book * book).sum(axis=1)[None, :]
        at = far.argmin(axis=1)
        return at, far[np.arange(len(a)), at]
    a, book = a.astype(object), book.astype(object)
    at, least = np.zeros(len(a), dtype=np.int64), ((a - book[0]) ** 2).sum(axis=1)
    for k in range(1, len(book)):
        far = ((a - book[k]) ** 2).sum(axis=1)
        better = (far < least).astype(bool)
        at[better], least[better] = k, far[better]
    return at, least


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length in float64, filled up with zeros."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _usable(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < RANGE))
    return df.filter(F.col(vector).isNotNull() & fine).select(F.col(ident).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))


def _in_steps(batches: Iterator[pa.RecordBatch], width: int, entries: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, MATRIX // max(width, entries))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            rows = batch.slice(start, step)
            yield rows, integers(matrix(rows.column("vector"), width), scale)


def _sums(rows: DataFrame, books: list[np.ndarray], width: int, scale: int) -> DataFrame:
    """(part, entry, position, n, low, high): per task, how many parts an entry got and their sums."""
    entries, wide = books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), entries), dtype=np.int64)
        sums = np.zeros((len(books), entries, wide), dtype=object)
        for _, numbers in _in_steps(batches, width, entries, scale):
            for p, book in enumerate(books):
                own = numbers[:, p * wide:(p + 1) * wide]
                at, _ = nearest(own, book)
                counts[p] += np.bincount(at, minlength=entries)
                added = np.zeros((entries, wide), dtype=own.dtype)
                np.add.at(added, at, own)
                sums[p] += added.astype(object)
        used = [(p, k) for p, k in zip(*np.nonzero(counts))]
        cells = [(int(p), int(k), i, int(counts[p, k]), sums[p, k, i]) for p, k in used for i in range(wide)]
        if cells:
            part, entry, position, n, total = zip(*cells)
            whole = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(position, pa.int32()), pa.array(n, pa.int64()),
                pa.array([Decimal(t & (1 << SPLIT_BIT) - 1) for t in total], whole), pa.array([Decimal(t >> SPLIT_BIT) for t in total], whole)],
                ["part", "entry", "position", "n", "low", "high"])

    found = rows.mapInArrow(run, "part int, entry int, position int, n long, low decimal(38,0), high decimal(38,0)")
    return found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def fit(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks of all parts after ``rounds`` rounds over all rows; none if no row can be used."""
    rows = _usable(df, ident, vector, ident).drop("label")
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return []
    wide = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()  # one codebook
    filled = np.zeros((len(first), wide * parts))
    for i, row in enumerate(first):
        filled[i, :len(row["vector"])] = row["vector"]
    start = integers(filled, scale)
    books = [start[:, p * wide:(p + 1) * wide] for p in range(parts)]
    for _ in range(rounds):
        new = [b.astype(object) for b in books]
        for r in _sums(rows, books, wide * parts, scale).collect():  # one number for each number of the codebooks
            new[r["part"]][r["entry"], r["position"]] = (int(r["low"]) + (int(r["high"]) << SPLIT_BIT)) // r["n"]
        books = [b.astype(np.int64) if _largest(b) < 1 << 52 else b for b in new]
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], ident: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of every usable row; longer vectors than the codebooks' are cut."""
    wide = books[0].shape[1]
    width = wide * len(books)
    rows = _usable(df, ident, vector, label).withColumn("vector", F.slice("vector", 1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, numbers in _in_steps(batches, width, len(books[0]), scale):
            found = [nearest(numbers[:, p * wide:(p + 1) * wide], book) for p, book in enumerate(books)]
            errors = sum(far.astype(object) for _, far in found)
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def vector_codes(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable row; the id column keeps its name."""
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair holds up to 256 entries")
    books = fit(df, ident, vector, parts, entries, rounds, scale)
    if not books:
        return _usable(df, ident, vector, label).limit(0).select(
            F.col("id").alias(ident), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(df, books, ident, vector, label, scale), "codes")
    whole = F.count("error") == F.count(F.lit(1))
    by_label = coded.groupBy(F.col("label").alias("_key")).agg(F.when(whole, F.try_sum("error")).alias("label_error"))
    return attach(coded, by_label, "label", F.struct("id", "code")).select(
        F.col("id").alias(ident), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    ctes = ["""vec AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """num AS MATERIALIZED (SELECT rn, (i - 1) // w AS part, (i - 1) % w AS pos, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT rn, embedding, len(embedding) // 4 AS w, unnest(range(1, len(embedding) + 1)) AS i FROM vec))""",
            "book0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, pos, x AS c FROM num WHERE rn <= 256)"]
    for r in range(ROUNDS + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (SELECT rn, part, min(far * 256 + entry) % 256 AS entry, min(far * 256 + entry) // 256 AS far
  FROM (SELECT rn, part, entry, sum((x - c) * (x - c))::BIGINT AS far FROM num JOIN book{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            ctes.append(f"""book{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM book{r} LEFT JOIN (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM num JOIN near{r} USING (rn, part) GROUP BY ALL) USING (part, entry, pos))""")
    last = ROUNDS
    return f"""WITH {', '.join(ctes)},
code AS (SELECT rn, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{last} GROUP BY rn)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{last}) AS codebooks_sha256 FROM code JOIN vec USING (rn)"""


ORACLE = _oracle()
