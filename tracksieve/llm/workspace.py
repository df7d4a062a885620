"""Tables of a run: reading inputs and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.operators.ordered import fits_broadcast
from tracksieve.session import shared_dir

#: Separators between words, the same in every operator: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, known size, and safe from a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, dims: DataFrame, key: str, salt: Column, salts: int = 32, how: str = "left") -> DataFrame:
    """Join one-row-per-key ``dims`` (its key column is ``_key``) to rows that may pile up on one key; nulls match nulls.

    ``dims`` is written first, so its size is known: below the session's broadcast
    threshold it is broadcast, beyond it every key is spread over ``salts`` parts.
    """
    dims = stored(dims, "dims")
    others = [c for c in dims.columns if c != "_key"]
    if fits_broadcast(dims):
        return df.join(F.broadcast(dims), df[key].eqNullSafe(dims["_key"]), how).select(df["*"], *[dims[c] for c in others])
    rows = df.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(salts)))  # hashed: a salt may be null or text
    parts = dims.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return rows.join(parts, rows[key].eqNullSafe(parts["_key"]) & (rows["_part"] == parts["_of"]), how).select(
        *[rows[c] for c in df.columns], *[parts[c] for c in others])
