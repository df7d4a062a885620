"""Integrity and lineage jobs: fingerprints, ledgers, store verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.quantiles import quantiles_of_counts, value_counts
from tracksieve.operators.checksums import tree_checksum
from tracksieve.operators.ordered import SEG, hash_segment, ranked


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(name, bytes[, sha256]) of the files under ``path``; without ``content`` no file is opened."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    if not content:
        return f.select(name, F.col("length").alias("bytes"))
    return f.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_files(found: DataFrame, manifest: DataFrame, key: Sequence[str] = ("name",)) -> DataFrame:
    """(key..., verdict): ok, missing, unlisted, size_mismatch or checksum_mismatch."""
    j = found.withColumn("_f", F.lit(True)).join(manifest.select(
        *key, F.col("bytes").alias("_mb"), F.col("sha256").alias("_ms"), F.lit(True).alias("_m")), list(key), "full_outer")
    verdict = (F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("bytes") != F.col("_mb"), "size_mismatch")
               .when(F.col("sha256") != F.col("_ms"), "checksum_mismatch").otherwise("ok"))
    return j.select(*key, verdict.alias("verdict"))


def tree_fingerprint(entries: DataFrame, keys: Sequence[str], name: str, line: Column) -> DataFrame:
    """Fingerprint per ``keys`` of any number of entries: lines in the order of their name hash, hashed as a tree."""
    h = entries.select(*keys, F.sha2(F.col(name).cast("string"), 256).alias("_h"), line.alias("_line")).withColumn(SEG, hash_segment("_h"))
    numbered = ranked(h, list(keys), ["_h"], "_r").select(*keys, (F.col("_r") - 1).alias("_no"), "_line")
    return tree_checksum(numbered, "_no", keys=keys, text="_line")


def ledger_fold(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Attempts and last event per task, with the next action.

    ``events`` has task, seq, status (complete / failed), retryable.
    """
    last = F.max_by(F.struct("status", "retryable"), "seq")
    f = events.groupBy("task").agg(F.count(F.lit(1)).alias("attempts"), F.max("seq").alias("last_seq"), last.alias("_l"))
    status, again = F.col("_l.status"), F.col("_l.retryable")
    action = (F.when(status == "complete", "skip").when(~again, "stop_final").when(F.col("attempts") >= max_attempts, "exhausted").otherwise("retry"))
    return f.select("task", "attempts", "last_seq", status.alias("last_status"), action.alias("next_action"))


def failure_events(ledger: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """Ledger failures and structural ambiguities in one event list."""
    a = ledger.where(F.col("status") != "complete").select("task", "seq", F.lit("ledger").alias("source"), F.when(F.col("retryable"), "retryable_failure").otherwise("final_failure").alias("failure_type"))
    b = ambiguities.select("task", F.lit("structure").alias("source"), F.lit("ambiguous_multiple_tids").alias("failure_type"))
    return a.unionByName(b, allowMissingColumns=True)


def access_accounting(accesses: DataFrame, expected: DataFrame, forbidden_split: str = "test") -> DataFrame:
    """Accesses, failures and first failing sequence per expected (split, track), with a forbidden flag; zero rows kept."""
    n = accesses.groupBy("split", "track").agg(
        F.count(F.lit(1)).alias("accesses"), F.count_if(F.col("status") != "complete").alias("failures"),
        F.min(F.when(F.col("status") != "complete", F.col("seq"))).alias("first_failure"))
    return expected.join(n, ["split", "track"], "full_outer").select(
        "split", "track", F.coalesce("accesses", F.lit(0)).alias("accesses"), F.coalesce("failures", F.lit(0)).alias("failures"), "first_failure",
        ((F.col("split") == forbidden_split) & (F.coalesce("accesses", F.lit(0)) > 0)).alias("forbidden"))


def operations_summary(ledger: DataFrame, measure: str, by: str) -> DataFrame:
    """Median (linear), p90 (rounded index), failure rate, retries and time span per group of a ledger with ``ts_micros``."""
    counts = value_counts(ledger, [by], measure)
    q = quantiles_of_counts(counts, [by], measure, {"median": (.5, "linear"), "p90": (.9, "rounded")}).drop("n")
    s = ledger.groupBy(by).agg(
        F.count(F.lit(1)).alias("events"), (F.count_if(F.col("status") != "complete") / F.count(F.lit(1))).alias("failure_rate"),
        F.count_if(F.col("retryable") & (F.col("status") != "complete")).alias("retries"), ((F.max("ts_micros") - F.min("ts_micros")) / 1e6).alias("span_seconds"))
    return s.join(q, by)


def verify_store(index: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of an index (key, fingerprint, complete) against recomputed fingerprints (key, fingerprint)."""
    i = index.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("fingerprint").alias("_fi"), F.bool_and("complete").alias("_c"))
    j = i.join(payload.select(key, F.col("fingerprint").alias("_fp")), key, "full_outer")
    verdict = (F.when(F.col("_n").isNull(), "not_indexed").when(F.col("_fp").isNull(), "payload_missing").when(F.col("_n") > 1, "duplicate_index_row")
               .when(~F.col("_c"), "incomplete").when(F.col("_fi") != F.col("_fp"), "fingerprint_mismatch").otherwise("ok"))
    return j.select(key, verdict.alias("verdict"))


def initialise_ledger(requested: DataFrame, existing: DataFrame, key: str = "task") -> DataFrame:
    """Requested keys keep their existing status or start pending; existing keys nobody requested are stale."""
    r = requested.select(key).distinct().withColumn("_r", F.lit(True))
    j = r.join(existing.select(key, F.col("status").alias("_s")), key, "full_outer")
    return j.select(key, F.when(F.col("_r").isNull(), "stale").otherwise(F.coalesce("_s", F.lit("pending"))).alias("status"))


def table_difference(now: DataFrame, published: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with ``surplus`` (now minus published); empty means equal.  One shuffle."""
    cols = now.columns
    both = now.withColumn("_d", F.lit(1)).unionByName(published.select(*cols).withColumn("_d", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_d").alias("surplus")).where(F.col("surplus") != 0)


def snapshot(name: str, df: DataFrame) -> DataFrame:
    """(source, rows, columns, field_sha256, status) of one source."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("source"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), field_hash(df).alias("field_sha256"),
        F.when(F.col("rows") > 0, "complete").otherwise("empty").alias("status"))


def field_hash(df: DataFrame) -> Column:
    """sha256 of the ordered column names."""
    return F.sha2(F.lit("\n".join(df.columns)), 256)


def seal_hash(rows: DataFrame, volatile: Sequence[str], out: str = "seal_sha256") -> DataFrame:
    """Add the hash of the canonical JSON of each row without its volatile fields (names sorted)."""
    keep = sorted(c for c in rows.columns if c not in set(volatile))
    return rows.withColumn(out, F.sha2(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}), 256))
