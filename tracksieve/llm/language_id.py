"""Language of a text by letter trigrams with interpolated Kneser-Ney smoothing, one model per language.

A text is lower-cased and read as words of letters.  Each letter, and the end of each word, is
predicted from the two letters before it inside its word, so neither batches nor neighbouring
texts matter.  Counts are added up by Spark, the smoothing is a join of three levels of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import stored, table

#: Characters of one step; a longer text is read in pieces, cut after a space where there is one.
PIECE = 1 << 19
SPACE = 32
BITS = 21  # of a code point
LOW = (1 << BITS) - 1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, parts) of about ``PIECE`` characters at a time."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        start = 0
        while text is not None and start < len(text):
            end = min(len(text), start + PIECE)
            if end < len(text):
                end = text.rfind(" ", start, end) + 1 or end
            part = text[start:end].lower()
            rows.append(row)
            parts.append(part)
            held, start = held + len(part), end
            if held >= PIECE:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def _trigrams(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Key of every predicted letter or word end (two letters before it and itself) and the row it is in."""
    codes = np.frombuffer(" ".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    before = np.concatenate(([False], letter[:-1]))
    keep = letter | before  # the first character after a word is its end
    of = np.repeat(np.asarray(rows, np.int64), [len(p) + 1 for p in parts])[keep]
    c = np.where(letter, codes, SPACE)[keep]
    b = np.concatenate(([SPACE], c[:-1]))
    a = np.where(b == SPACE, SPACE, np.concatenate(([SPACE], b[:-1])))
    return (a << 2 * BITS) | (b << BITS) | c, of


def trigram_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(label, key, n): trigrams of the texts of every label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, which = np.unique(np.asarray(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for rows, parts in _pieces(batch.column(0).to_pylist()):
                keys, of = _trigrams(rows, parts)
                of = which[of]
                for i in np.unique(of):
                    seen, n = np.unique(keys[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(names[i])] * len(seen)), pa.array(seen), pa.array(n.astype(np.int64))], ["label", "key", "n"])

    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text), F.col(label).cast("string"))
    return rows.mapInArrow(count, "label string, key bigint, n bigint").groupBy("label", "key").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame, context: list[str]) -> DataFrame:
    """Adds ``own``, the discounted share of a count in its context, and ``rest``, the share its context leaves to the level below."""
    ones = counts.groupBy("label").agg(F.count_if(F.col("n") == 1).alias("_1"), F.count_if(F.col("n") == 2).alias("_2"))
    d = F.when(F.col("_1") > 0, F.col("_1") / (F.col("_1") + 2 * F.col("_2"))).otherwise(0.5)
    d = F.least(d, F.lit(0.95))  # a level of ones only would leave nothing to what was seen
    sums = counts.groupBy("label", *context).agg(F.sum("n").alias("_sum"), F.count(F.lit(1)).alias("_kinds"))
    each = counts.join(F.broadcast(ones.select("label", d.alias("_d"))), "label").join(sums, ["label", *context])
    return each.withColumns({"own": (F.col("n") - F.col("_d")) / F.col("_sum"), "rest": F.col("_d") * F.col("_kinds") / F.col("_sum")}).drop("_d", "_sum", "_kinds")


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trigrams, bigrams and letters with ``p`` and ``rest``; the lower two count kinds of left neighbours, as Kneser-Ney does."""
    key = F.col("key")
    three = counts.select("label", F.shiftright(key, 2 * BITS).alias("a"), F.shiftright(key, BITS).bitwiseAND(LOW).alias("b"), key.bitwiseAND(LOW).alias("c"), "n")
    two = three.groupBy("label", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    one = two.groupBy("label", "c").agg(F.count(F.lit(1)).alias("n"))
    kinds = one.agg(F.count_distinct("c") + 1).scalar()  # and one for every letter that was never seen
    ones = stored(_discounted(one, []).withColumn("p", F.col("own") + F.col("rest") / kinds).withColumn("unseen", F.col("rest") / kinds), "letters")
    twos = _discounted(two, ["b"]).join(ones.select("label", "c", F.col("p").alias("_p")), ["label", "c"])
    twos = stored(twos.withColumn("p", F.col("own") + F.col("rest") * F.col("_p")), "bigrams")
    threes = _discounted(three, ["a", "b"]).join(twos.select("label", "b", "c", F.col("p").alias("_p")), ["label", "b", "c"])
    return threes.withColumn("p", F.col("own") + F.col("rest") * F.col("_p")), twos, ones


@dataclass
class Model:
    """Logarithms of one column per label; a key that a level lacks falls to the level below."""

    labels: list[str]
    prior: np.ndarray
    unseen: np.ndarray
    keys: list[np.ndarray]  # sorted keys of letters, bigrams, trigrams
    logs: list[np.ndarray]
    contexts: list[np.ndarray]  # sorted contexts of bigrams, trigrams
    rests: list[np.ndarray]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_p(self, wanted: np.ndarray, level: int = 2) -> np.ndarray:
        at, there = self._find(self.keys[level], wanted)
        out = self.logs[level][at]
        if not there.all():
            out[~there] = self.lower(wanted[~there], level)
        return out

    def lower(self, wanted: np.ndarray, level: int) -> np.ndarray:
        """What the level below gives, times what the context leaves to it (all, where it was never seen)."""
        if level == 0:
            return np.broadcast_to(self.unseen, (len(wanted), len(self.labels)))
        at, there = self._find(self.contexts[level - 1], wanted >> BITS)
        rest = np.where(there[:, None], self.rests[level - 1][at], 0.0)
        return rest + self.log_p(wanted & ((1 << level * BITS) - 1), level - 1)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of every text's likelihood by label, and its number of predictions."""
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for rows, parts in _pieces(texts):
            keys, of = _trigrams(rows, parts)
            n += np.bincount(of, minlength=len(texts))
            logs = self.log_p(keys)
            for i in range(len(self.labels)):
                total[:, i] += np.bincount(of, logs[:, i], len(texts))
        return total, n


def learn(df: DataFrame, text: str, label: str) -> Model | None:
    """The model of all labelled texts, None without any.  Its size follows the trigrams of the alphabets, not the rows."""
    shares = {r[0]: r[1] for r in df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect()}
    three, two, one = smoothed(stored(trigram_counts(df, text, label), "trigrams"))
    key = [F.col("c"), F.col("b") * (1 << BITS) + F.col("c"), (F.col("a") * (1 << BITS) + F.col("b")) * (1 << BITS) + F.col("c")]
    levels = [d.select("label", k.alias("key"), "p", "rest", (F.col("unseen") if d is one else F.lit(0.0)).alias("unseen")).toPandas() for d, k in zip((one, two, three), key)]
    labels = sorted(set(levels[0]["label"]))
    if not labels:
        return None
    column = {x: i for i, x in enumerate(labels)}
    prior = np.log(np.asarray([shares[x] for x in labels]) / sum(shares[x] for x in labels))
    unseen = np.log(levels[0].groupby("label")["unseen"].first()[labels].to_numpy())
    model = Model(labels, prior, unseen, [], [], [], [])
    for level, rows in enumerate(levels):
        of, values = rows["label"].map(column).to_numpy(), rows["key"].to_numpy()
        keys, at = np.unique(values, return_inverse=True)
        if level:
            contexts, where = np.unique(values >> BITS, return_inverse=True)
            rests = np.zeros((len(contexts), len(labels)))
            rests[where, of] = np.log(rows["rest"].to_numpy())
            model.contexts.append(contexts)
            model.rests.append(rests)
        logs = model.lower(keys, level).copy()
        logs[at, of] = np.log(rows["p"].to_numpy())
        model.keys.append(keys)
        model.logs.append(logs)
    return model


def predict(df: DataFrame, text: str, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep``, lang_pred and score of every row: the likeliest label and its share among the labels.

    Neighbouring letters are not independent, so the evidence of n predictions counts as that of the square root of n.
    """
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    if model is None:
        return df.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = model.score(batch.column(len(keep)).to_pylist())
            evidence = model.prior + total / np.sqrt(np.maximum(n, 1.0))[:, None]
            best = (model.prior + total).argmax(axis=1)
            shares = np.exp(evidence - evidence.max(axis=1, keepdims=True))
            share = shares[np.arange(len(n)), best] / shares.sum(axis=1)
            names = [model.labels[i] if k else UNKNOWN for i, k in zip(best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(names, pa.string()), pa.array(np.where(n > 0, share, 0.0))], [*keep, "lang_pred", "score"])

    return df.select(*keep, text).mapInArrow(judge, schema)


def held_out(doc_id: str) -> Column:
    """True for the fifth of the documents that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out("doc_id")), "text", "lang")
    # a document without an id is not learned from either
    rows = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"), "text")
    return predict(rows, "text", model, ["doc_id", "held_out"])
