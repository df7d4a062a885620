"""File stores of any size: content hashes, states before and after a job, snapshots of sources.

A file is never one cell.  It is read as records between line feeds, in splits; every record
is hashed where it is read, numbered within its file by the counts of the splits before, and a
tree of the hashes gives the value of the file.  So the value depends on the bytes and not on
the splits.  Only a stretch without any line feed is one cell (binary content has one about
every 256 bytes).  Files with a suffix of a compression codec are hashed as what they hold;
a damaged one ends early and so differs from its manifest.  An empty file has no split: it is
not listed, and an audit calls it missing.
"""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksieve.operators.checksums import tree_checksum
from tracksieve.operators.integrity import tree_fingerprint
from tracksieve.operators.ordered import fits_broadcast
from tracksieve.session import cut_lineage

PARTIAL = r"\.partial(/|$)"
SNAPSHOT = ("source string, status string, files bigint, bytes bigint, rows bigint, columns bigint, "
            "content_sha256 string, read_at timestamp, seconds double, failure string")


def _within(path: Column, root: str) -> Column:
    """The name of a file below ``root``."""
    bare = root.split(":", 1)[-1].strip("/") if ":" in root.split("/", 1)[0] else root.strip("/")
    return F.substring_index(path, f"/{bare}/", -1)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, modified) of the files below ``root``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_within(F.col("path"), root).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def line_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(name, line, sha256): every record between line feeds of every file, numbered from 0 within its file."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(root)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = cut_lineage(text.select(
        _within(path, root).alias("name"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256")))
    # ids rise by one along a split, so a split needs only its first id and the records before it
    blocks = rows.groupBy("name", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cut_lineage(blocks.select("name", "_block", (before - F.col("_first")).alias("_shift")))
    joined = rows.join(F.broadcast(blocks) if fits_broadcast(blocks) else blocks, ["name", "_block"])
    return joined.select("name", (F.col("_id") + F.col("_shift")).alias("line"), "sha256")


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, lines, sha256) of every file below ``root``; lines and hash are null for a file of which nothing could be read."""
    trees = tree_checksum(line_hashes(spark, root), "line", keys=["name"], text="sha256").select("name", F.col("ids").alias("lines"), "sha256")
    return listing(spark, root).drop("modified").join(trees, "name", "left").select("name", "bytes", "lines", "sha256")


def entry_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, files, sha256) of every entry directly below ``root``: a file, or a folder with all files in it.

    A table is one entry, whether it is written as one file or as many.
    """
    files = cut_lineage(content_hashes(spark, root).select(F.substring_index("name", "/", 1).alias("entry"), "name", "bytes", "sha256"))
    trees = tree_fingerprint(files, ["entry"], "name", F.concat_ws("\t", "name", F.col("bytes").cast("string"), "sha256"))
    sums = files.groupBy("entry").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    return sums.join(trees, "entry").select(F.col("entry").alias("name"), "bytes", "files", "sha256")


def audit(found: DataFrame, manifest: DataFrame, key: str = "name") -> DataFrame:
    """(key, verdict) of files (key, bytes, sha256, partial) against a manifest (key, bytes, sha256) made before them.

    ok, missing, partial, unlisted, truncated (fewer bytes), size_mismatch (more) or damaged (same size).
    """
    listed = manifest.select(key, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_listed"))
    j = found.withColumn("_found", F.lit(True)).join(listed, key, "full_outer")
    verdict = (F.when(F.col("_found").isNull(), "missing").when(F.col("partial"), "partial").when(F.col("_listed").isNull(), "unlisted")
               .when(F.col("bytes") < F.col("_bytes"), "truncated").when(F.col("bytes") > F.col("_bytes"), "size_mismatch")
               .when(~F.col("sha256").eqNullSafe(F.col("_sha256")), "damaged").otherwise("ok"))
    return j.select(key, verdict.alias("verdict"))


def store_state(spark: SparkSession, root: str) -> DataFrame:
    """(files, bytes, partial_files, sha256) from the listing alone: any file added, lost, resized or rewritten changes the hash."""
    files = listing(spark, root).withColumn("_store", F.lit(0))
    line = F.concat_ws("\t", "name", F.col("bytes").cast("string"), F.unix_micros("modified").cast("string"))
    tree = tree_fingerprint(files, ["_store"], "name", line).select("_store", "sha256")
    sums = files.groupBy("_store").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.rlike("name", F.lit(PARTIAL))).alias("partial_files"))
    return sums.join(tree, "_store").drop("_store")


def snapshot_source(spark: SparkSession, name: str, root: str, kind: str = "text", **options: str) -> DataFrame:
    """One row of one source: complete, empty, or failed with the reason; never an error."""
    began, at = time.time(), spark.sql("SELECT current_timestamp()").first()[0]
    row: dict = {}
    try:
        df = spark.read.format(kind).options(recursiveFileLookup="true", **options).load(root)
        files = content_hashes(spark, root).withColumn("_source", F.lit(name))
        whole = tree_fingerprint(files, ["_source"], "name", F.concat_ws("\t", "name", F.col("bytes").cast("string"), "sha256")).first()
        sums = files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).first()
        row = {"files": sums["files"], "bytes": sums["bytes"] or 0, "rows": df.count(), "columns": len(df.columns), "content_sha256": whole and whole["sha256"]}
        status, failure = ("complete" if row["rows"] else "empty"), None
    except PySparkException as error:
        status, failure = "failed", error.getCondition() or type(error).__name__
    names = ("files", "bytes", "rows", "columns", "content_sha256")
    return spark.createDataFrame([(name, status, *[row.get(n) for n in names], at, time.time() - began, failure)], SNAPSHOT)
