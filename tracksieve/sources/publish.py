"""Tables that become visible only after their gates: written aside, checked, then named in a log of versions.

The counts behind the gates come from the writing pass itself (``observe``); only the cover of
the keys reads the staged table again, its key columns alone.  A version is visible once its
line is in the log, so readers see the old table whole or the new one whole, and a failing or
lost attempt leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import is_finite

_LOG = "version bigint, folder string, ddl string"


class Gate(NamedTuple):
    gate: str
    observed: int
    passed: bool


def _log(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(_LOG).json(f"{path}/log").orderBy(F.desc("version")).limit(1).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The visible version, none if nothing was published yet."""
    last = _log(spark, path)
    return spark.read.schema(last[0]["ddl"]).parquet(f"{path}/{last[0]['folder']}") if last else None


def publish(df: DataFrame, path: str, columns: Sequence[str], *, rows: int | None = None, not_null: Sequence[str] = (), finite: Sequence[str] = (),
            key: Sequence[str] = (), cover: DataFrame | None = None) -> list[Gate]:
    """Write a new version of the table at ``path`` and make it visible if every gate passes.

    Gates: column order; row count (``rows``); nulls and non-finite numbers per column named;
    repeated keys; and, against the keys of ``cover``, missing and extra ones.
    """
    spark = df.sparkSession
    before = _log(spark, path)
    folder = f"version-{uuid.uuid4().hex}"
    seen = Observation()
    here = [c for c in df.columns]
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null if c in here]
    counts += [F.count_if(~is_finite(c)).alias(f"non_finite_{c}") for c in finite if c in here]
    df.observe(seen, *counts).write.parquet(f"{path}/{folder}")
    found = {c: seen.get[c] for c in seen.get}
    gates = [Gate("column_order", int(here != list(columns)), here == list(columns))]
    gates.append(Gate("rows", found.pop("rows"), rows is None or seen.get["rows"] == rows))
    gates += [Gate(name, n, n == 0) for name, n in found.items()]
    if key and set(key) <= set(here):
        staged = spark.read.schema(df.schema).parquet(f"{path}/{folder}").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        if cover is None:
            repeated = staged.agg(F.count_if(F.col("_n") > 1)).first()[0]
            gates.append(Gate("repeated_keys", repeated, repeated == 0))
        else:
            wanted = cover.select(*key).distinct().withColumn("_w", F.lit(True))
            r = staged.join(wanted, list(key), "full_outer").agg(
                F.count_if(F.col("_n") > 1), F.count_if(F.col("_n").isNull()), F.count_if(F.col("_w").isNull())).first()
            gates += [Gate(name, n, n == 0) for name, n in zip(("repeated_keys", "missing_keys", "extra_keys"), r)]
    if all(g.passed for g in gates):
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        version = before[0]["version"] + 1 if before else 1
        spark.createDataFrame([(version, folder, ddl)], _LOG).coalesce(1).write.mode("append").json(f"{path}/log")
    return gates
