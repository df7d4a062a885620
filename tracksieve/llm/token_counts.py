"""Token counts: every distinct pre-token is encoded once, and documents sum the counts of their pre-tokens.

A byte-level BPE never merges across pre-tokens, so a document has as many tokens as its
pre-tokens have together, plus one for each special string.  The work has four steps:

1. Documents are split into pre-tokens by blocks of about ``BLOCK_CHARS`` code points.  A block
   lists its distinct pre-tokens once; a document keeps (place in that list, frequency) pairs.
2. The lists meet by pre-token and are sorted, so that a run of equal ones, from all blocks, is
   encoded once.  A pre-token comes at most once from a block: no frequent one is a hot key.
3. The counts go back to their block, one number for each place.
4. A block's documents and its counts meet and are multiplied.

Token ids of documents never exist.  Memory is bounded by a block; the split is written to the
shared folder before it is used, as blocks are numbered by the task that made them.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows, repeated and null ids keep
one row each; a text longer than a block is a block of its own, and is streamed; an empty table
gives an empty table; other columns are not passed on, so none can clash.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import stored, table

BLOCK_CHARS = 32_000_000
LIMIT = 512
#: Texts over this many code points are matched one by one instead of as a list.
STREAMED = 1_000_000

# Fixed value: the pre-token pattern of byte-level BPE files with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE_TOKEN = regex.compile(PATTERN)


def special_strings(path: str) -> list[str]:
    """The special strings of a tokenizer file; an error if the file does not split as this operator does."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    if not plain or spec["model"].get("type") != "BPE" or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    return sorted((t["content"] for t in added), key=len, reverse=True)


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """By code point: whether Python's Unicode tables do not know it, so that libraries may differ on its class."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


def _disputed(text: str) -> bool:
    if text.isascii():
        return False
    slices = (text[i:i + STREAMED] for i in range(0, len(text), STREAMED))
    return any(_unassigned()[np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)].any() for s in slices)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(path: str, text: str) -> Iterable[str]:
    """The pre-tokens of a text: by the pattern, or by the library itself where a code point is newer than Python's tables."""
    if _disputed(text):
        return (text[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(text))
    return _PRE_TOKEN.findall(text) if len(text) <= STREAMED else (m.group() for m in _PRE_TOKEN.finditer(text))


def splitter(path: str):
    """A function text -> (frequencies of its pre-tokens, number of special strings)."""
    specials = special_strings(path)
    cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def split(text: str) -> tuple[Counter, int]:
        found: Counter = Counter()
        parts = cut.split(text) if cut else [text]
        for part in parts:
            found.update(pre_tokens(path, part))
        return found, len(parts) - 1

    return split


def pieces_of(path: str, words: list[str]) -> list[int]:
    """Tokens of each pre-token."""
    return [len(e) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte plane by byte plane: the high planes are nearly all zero."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def split_blocks(df: DataFrame, path: str, ident: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of documents (block, id, n_bytes, specials, places, times) and rows of lists (block, start, words), in one table."""
    source = df.select(F.col(ident).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(text, F.lit("")).alias("text"))
    split = splitter(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars = TaskContext.get().partitionId() << 32, 0
        words: dict[str, int] = {}

        def lists(block: int) -> Iterator[pa.RecordBatch]:
            every = list(words)
            for start in range(0, len(every), 10_000):
                one = pa.array([every[start:start + 10_000]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                    pa.array([start]), one], names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            at, blocks, specials, places, times = 0, [], [], [], []
            for scalar in batch.column("text"):
                value = scalar.as_py()
                found, special = split(value)
                blocks.append(block)
                specials.append(special)
                place = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found))
                order = np.argsort(place)
                places.append(_packed(np.diff(place[order], prepend=0)))
                times.append(_packed(np.fromiter(found.values(), np.int64, len(found))[order]))
                chars += len(value)
                if chars >= block_chars or len(blocks) == batch.num_rows - at:
                    n = len(blocks)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(blocks, pa.int64()), batch.column("id").slice(at, n), batch.column("n_bytes").slice(at, n), pa.array(specials, pa.int64()),
                        pa.array(places, pa.binary()), pa.array(times, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.string()))], names)
                    at, blocks, specials, places, times = at + n, [], [], [], []
                if chars >= block_chars:
                    yield from lists(block)
                    block, chars = block + 1, 0
                    words.clear()
        if words:
            yield from lists(block)

    names = ["block", "id", "n_bytes", "specials", "places", "times", "start", "words"]
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"block long, id {kind}, n_bytes long, specials long, places binary, times binary, start long, words array<string>")


def encode_words(split: DataFrame, path: str) -> DataFrame:
    """(block, place, pieces) of every listed pre-token; equal ones of all blocks are encoded once."""
    listed = split.filter(F.col("words").isNotNull()).select("block", "start", F.posexplode("words").alias("at", "word"))
    listed = listed.select(F.col("block"), (F.col("start") + F.col("at")).cast("int").alias("place"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, 0
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = [pieces] if words and words[0] == last else []
            counts = np.array(known + pieces_of(path, words[len(known):]), dtype=np.int32)
            if words:
                at = coded.indices.to_numpy()
                last, pieces = words[at[-1]], int(counts[at[-1]])
                yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), pa.array(counts[at], pa.int32())], ["block", "place", "pieces"])

    return listed.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, place int, pieces int")


def count_tokens(df: DataFrame, path: str, ident: str = "doc_id", text: str = "text", limit: int = LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``df``; the id column keeps its name."""
    split = stored(split_blocks(df, path, ident, text, block_chars), "split", "zstd")
    documents = split.filter(F.col("words").isNull()).select("block", "id", "n_bytes", "specials", "places", "times")

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        pieces = np.zeros(words.num_rows, dtype=np.int64)
        pieces[words.column("place").to_numpy()] = words.column("pieces").to_numpy()
        tokens = [int(pieces[np.cumsum(_unpacked(p.as_py()))] @ _unpacked(t.as_py()).astype(np.int64)) for p, t in zip(rows.column("places"), rows.column("times"))]
        return pa.table({"id": rows.column("id"), "n_bytes": rows.column("n_bytes"),
                         "n_tokens": pa.array(np.array(tokens, dtype=np.int64) + rows.column("specials").to_numpy(), pa.int64())})

    kind = dict(documents.dtypes)["id"]
    counted = documents.groupBy("block").cogroup(encode_words(split, path).groupBy("block")).applyInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(ident), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the tokenizer file that is installed on every machine."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
