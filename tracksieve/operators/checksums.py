"""Order-independent checksums: flat for bounded sets, a hash tree for sets of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 1024


def _hash_lines(order: Column, line: Column) -> Column:
    """sha256 of the lines in order, each ended by a newline."""
    return F.sha2(_joined(order, line), 256)


def _joined(order: Column, line: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.concat(F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), F.lit("\n"))


def _lines(number: str, text: str | Column | None) -> Column:
    return F.col(number).cast("string") if text is None else (F.col(text) if isinstance(text, str) else text)


def flat_checksum(ids: DataFrame, number: str, text: str | Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """sha256 of all ids in numeric order, one per line: (ids, sha256); none of an empty set.

    A flat hash is one sequence by definition.  Blocks of ``fanout`` consecutive numbers are joined
    in parallel; one task then hashes the blocks as they stream by in order and holds one of them.
    Where the value need not be the flat one, ``tree_checksum`` has no such sequence.
    """
    blocks = ids.select(F.col(number).alias("_o"), _lines(number, text).alias("_l")).groupBy(F.floor(F.col("_o") / fanout).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), _joined(F.col("_o"), F.col("_l")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for text in batch.column("lines"):
                digest.update(text.as_buffer())
            n += sum(batch.column("n").to_pylist())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([digest.hexdigest()])], ["ids", "sha256"])

    return blocks.repartition(1).sortWithinPartitions("block").mapInArrow(run, "ids long, sha256 string")


def tree_checksum(ids: DataFrame, number: str, *, keys: Sequence[str] = (), text: str | Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """(keys, ids, sha256): hash tree over blocks of ``fanout`` consecutive numbers, of as many levels as the numbers need.

    A node hashes the lines (leaves: ids, above: child hashes) of its block in order, so no task
    gathers more than ``fanout`` lines.  A key whose only node is block 0 is done: further levels
    leave it as it is, so its value does not depend on how far other keys reach.  Ids must be
    unique and not negative.
    """
    keys = list(keys)
    node = ids.select(*keys, F.col(number).cast("bigint").alias("_o"), _lines(number, text).alias("_l"), F.lit(1).cast("bigint").alias("_n"))
    largest = node.agg(F.max("_o")).first()[0] or 0
    level = 0
    while level == 0 or largest > 0:
        alone = (F.count(F.lit(1)) == 1) & (F.max("_o") == 0) if level else F.lit(False)
        node = node.groupBy(*keys, F.floor(F.col("_o") / fanout).cast("bigint").alias("_p")).agg(
            F.when(alone, F.max("_l")).otherwise(_hash_lines(F.col("_o"), F.col("_l"))).alias("_l"), F.sum("_n").alias("_n"))
        node = node.select(*keys, F.col("_p").alias("_o"), "_l", "_n")
        largest, level = largest // fanout, level + 1
    return node.select(*keys, F.col("_n").alias("ids"), F.col("_l").alias("sha256"))
