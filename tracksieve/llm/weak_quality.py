"""Quality of a text learned without labels: votes of rules, a label model fitted by EM, a hashed linear scorer.

Every rule votes good, bad or nothing.  EM estimates from the patterns of votes how far each rule is
to be believed, and gives every pattern its probability of being good.  A linear scorer over hashed
letter pairs learns these probabilities by ridge regression.  One pass adds up its matrix and one
feature sum for every pattern; both have a fixed size, so only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.language_id import SPACE, _pieces
from tracksieve.llm.quality_rules import measures, ratios
from tracksieve.llm.workspace import table

PAIRS = 252  # hashed features
DENSE = ("duplicate_line_share", "repeat_share", "symbol_share")
WIDTH = PAIRS + len(DENSE) + 1  # and a constant
RIDGE = 1e-4
ROUNDS = 100
SILENT = "------"  # the pattern without a vote


def votes() -> dict[str, Column]:
    """-1 bad, 1 good, 0 no vote, from the measures of a text."""
    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    r, n = ratios(), F.col("n_words")
    repeat = F.when(n > 0, F.col("n_repeat_words") / n).otherwise(0.0)
    return {
        "length": vote(n < 50, n >= 100), "word_length": vote((r["chars_per_word"] < 2) | (r["chars_per_word"] > 12), r["chars_per_word"].between(3, 8)),
        "symbols": vote(r["symbols_per_word"] > 0.1, r["symbols_per_word"] < 0.02), "stop_words": vote(r["stop_word_share"] < 0.02, r["stop_word_share"] >= 0.1),
        "lines": vote(r["duplicate_line_share"] > 0.3, (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)), "repeats": vote(repeat > 0.3, repeat < 0.1)}


def believed(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of being good of every pattern of votes (rows of -1, 0, 1), by EM with independent rules in each class.

    It starts from "no rule says bad", which also tells the classes apart.
    """
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    cast = patterns[:, :, None] == np.asarray([-1, 0, 1])
    for _ in range(ROUNDS):
        logs = []
        for share in (good, 1 - good):
            weight = share * counts
            odds = (np.einsum("p,pjo->jo", weight, cast) + 1) / (weight.sum() + 3)
            logs.append(np.log((weight.sum() + 1) / (counts.sum() + 2)) + np.einsum("pjo,jo->p", cast, np.log(odds)))
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
    return good


def _features(texts: list[str | None], dense: list[np.ndarray]) -> np.ndarray:
    """Square roots of the shares of hashed letter pairs, shares of repetition and symbols, and a constant."""
    out = np.zeros((len(texts), WIDTH))
    for rows, parts in _pieces(texts):
        codes = np.frombuffer(" ".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pair = (np.concatenate((np.asarray([SPACE], np.uint64), codes[:-1])) << np.uint64(21)) | codes
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(PAIRS)
        first = rows[0]  # the rows of a piece are neighbours
        of = np.repeat(np.asarray(rows) - first, [len(p) + 1 for p in parts])
        height = rows[-1] - first + 1
        out[first:first + height, :PAIRS] += np.bincount(of * PAIRS + bucket.astype(np.int64), minlength=height * PAIRS).reshape(height, PAIRS)
    out[:, :PAIRS] = np.sqrt(out[:, :PAIRS] / np.maximum(out[:, :PAIRS].sum(axis=1, keepdims=True), 1))
    for i, values in enumerate(dense):
        out[:, PAIRS + i] = np.minimum(values, 1.0)
    out[:, -1] = 1.0
    return out


def judged(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``text``, n_words, pattern (one letter per rule) and the dense features of every row."""
    r, n = ratios(), F.col("n_words")
    pattern = F.concat(*[F.element_at(F.array(F.lit("b"), F.lit("-"), F.lit("g")), v + 2) for v in votes().values()])
    dense = (r["duplicate_line_share"], F.when(n > 0, F.col("n_repeat_words") / n).otherwise(0.0), r["symbols_per_word"])
    return measures(df, text).select(*keep, text, "n_words", pattern.alias("pattern"), *[c.cast("double").alias(x) for x, c in zip(DENSE, dense)])


def sums(rows: DataFrame, text: str) -> DataFrame:
    """(pattern, i, j, x) over the rows with a vote: the upper half of the feature matrix (pattern '') and per pattern its feature sums (i = -1)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, of = np.zeros((WIDTH, WIDTH)), {}
        for batch in batches:
            # here and not as a filter, which Spark would push below the measures and so repeat their nested expressions
            batch = batch.filter(pc.not_equal(batch.column(1), SILENT))
            x = _features(batch.column(0).to_pylist(), [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(DENSE))])
            matrix += x.T @ x
            names, which = np.unique(np.asarray(batch.column(1).to_pylist(), str), return_inverse=True)
            for k, name in enumerate(names):
                of[str(name)] = of.get(str(name), 0) + x[which == k].sum(axis=0)
        if of:
            cells = [("", i, i, matrix[i, i:]) for i in range(WIDTH)] + [(name, -1, 0, v) for name, v in of.items()]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells]), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.int32()),
                                              pa.array([c[3].tolist() for c in cells], pa.list_(pa.float64()))], ["pattern", "i", "from", "v"])

    parts = rows.select(text, "pattern", *DENSE).mapInArrow(add, "pattern string, i int, from int, v array<double>")
    return parts.select("pattern", "i", "from", F.posexplode("v").alias("j", "x")).groupBy(
        "pattern", "i", (F.col("from") + F.col("j")).alias("j")).agg(F.sum("x").alias("x"))


def learn(rows: DataFrame, text: str) -> tuple[np.ndarray, dict[str, float]]:
    """Weights of the scorer and the probability of every pattern; rows without any vote teach nothing."""
    cells = sums(rows, text).toPandas()
    if cells.empty:
        return np.zeros(WIDTH), {}
    half = cells[cells["i"] >= 0]
    matrix = np.zeros((WIDTH, WIDTH))
    matrix[half["i"], half["j"]] = half["x"]
    matrix = matrix + np.triu(matrix, 1).T
    of = cells[cells["i"] < 0].pivot(index="pattern", columns="j", values="x").sort_index()
    names, vectors = list(of.index), of.to_numpy()
    counts = vectors[:, -1]  # sums of the constant
    good = believed(np.asarray([["b-g".index(v) - 1 for v in name] for name in names]), counts)
    weights = np.linalg.solve(matrix + RIDGE * counts.sum() * np.eye(WIDTH), good @ vectors)
    return weights, dict(zip(names, good.tolist()))


def score(rows: DataFrame, text: str, keep: list[str], weights: np.ndarray, known: dict[str, float]) -> DataFrame:
    """``keep``, n_words, pattern, weak_label (null without a vote), score (0 to 1) and kept of every row."""
    schema = rows.select(*keep, "n_words", "pattern").schema.add("weak_label", "double").add("score", "double").add("kept", "boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column(len(keep) + 2).to_pylist(), [batch.column(len(keep) + 3 + i).to_numpy(zero_copy_only=False) for i in range(len(DENSE))])
            found = np.round(np.clip(x @ weights, 0.0, 1.0), 6)
            words = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            weak = [known.get(p) for p in batch.column(len(keep) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 2], pa.array(weak, pa.float64()), pa.array(found), pa.array((found >= 0.5) & (words > 0))], schema.names)

    return rows.select(*keep, "n_words", "pattern", text, *DENSE).mapInArrow(judge, schema)


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, pattern, weak_label, score, kept of all documents; a null or empty text is never kept."""
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
    return score(rows, "text", ["doc_id"], *learn(rows, "text"))
