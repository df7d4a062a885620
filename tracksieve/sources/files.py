"""File sources and sinks: text snapshots, checked manifests, raw tracks, partitioned and array tables, logs."""

from __future__ import annotations

import csv
import gzip
import io
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksieve.functions.columns import is_finite, strict_bool


def read_snapshot(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = False) -> DataFrame:
    """CSV with header, every cell as text (gzip by suffix, byte order mark ignored); empty cells are empty text.

    The header is checked against ``columns``: a different one fails the read.
    ``multiline`` allows line breaks inside cells, at the price of unsplittable files.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(
        header="true", enforceSchema="false", mode="FAILFAST", emptyValue="", nullValue="\u0000", escape='"', multiLine=str(multiline).lower()).csv(path)


def snapshot_stats(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, sha256) of the files of a snapshot, sha256 over the sorted file hashes of each name block."""
    from tracksieve.operators.integrity import list_files, tree_fingerprint

    f = list_files(spark, path, content=True).where(~F.col("name").startswith("_")).withColumn("store", F.lit("snapshot"))
    tree = tree_fingerprint(f, ["store"], "name", F.col("sha256"))
    size = f.groupBy("store").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return size.join(tree, "store").select("files", "bytes", "sha256")


# --- manifests -------------------------------------------------------------------

def _decode(name: str, kind: T.DataType, nullable: bool) -> Column:
    raw = F.col(name)
    empty = raw.isNull() | (raw == "")
    if isinstance(kind, T.BooleanType):
        value = strict_bool(raw)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value = F.from_json(raw, kind, {"mode": "FAILFAST"})
    elif isinstance(kind, T.StringType):
        value = raw
    else:
        parsed = raw.try_cast(kind)
        value = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit(f"{name}: cannot read "), raw)).cast(kind))
    missing = F.lit(None).cast(kind) if nullable else F.raise_error(F.lit(f"{name}: empty cell")).cast(kind)
    if isinstance(kind, T.StringType) and not nullable:
        return F.coalesce(raw, F.lit("")).alias(name)
    return F.when(empty, missing).otherwise(value).alias(name)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of a CSV manifest: header order checked, JSON cells parsed, booleans strict, '' null where allowed."""
    text = read_snapshot(spark, path, schema.names)
    return text.select(*[_decode(f.name, f.dataType, f.nullable) for f in schema.fields])


def _encode(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(name).alias(name)
    return F.col(name).cast("string").alias(name)


def write_manifest(df: DataFrame, path: str, schema: T.StructType, mode: str = "errorifexists", compression: str = "none") -> None:
    """CSV in schema order with JSON cells; Spark's commit protocol publishes it as a whole or not at all."""
    df.select(*[_encode(f.name, f.dataType) for f in schema.fields]).write.mode(mode).options(
        header="true", emptyValue="", nullValue="", compression=compression, escape='"').csv(path)


# --- raw tracks --------------------------------------------------------------------

_LINES = "path string, seq bigint, head string, name string, fields int, raw_t string, raw_v string, error string"
BATCH = 50_000


def _decode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decompress (by magic bytes) and split files into numbered rows, a bounded batch at a time."""
    names = ["path", "seq", "head", "name", "fields", "raw_t", "raw_v", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            stream = io.BytesIO(content)
            binary = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
            rows: list[tuple] = []
            head = name = None
            seq = 0
            try:
                reader = csv.reader(io.TextIOWrapper(binary, encoding="utf-8-sig", newline=""))
                first = next(reader, None)
                if first is None:
                    yield pd.DataFrame([(path, 0, None, None, 0, None, None, "no_header")], columns=names)
                    continue
                head, name = (first[0].strip() if first else ""), (first[1].strip() if len(first) > 1 else None)
                for row in reader:
                    if not row:
                        continue
                    seq += 1
                    rows.append((path, seq, head, name, len(row), row[0], row[1].strip() if len(row) > 1 else None, None))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if seq == 0:
                    rows.append((path, 0, head, name, 0, None, None, "empty_signal"))
            except (OSError, EOFError, UnicodeDecodeError, csv.Error) as error:
                rows.append((path, seq + 1, head, name, 0, None, None, f"decode_failed:{type(error).__name__}"))
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_tracks(spark: SparkSession, path: str, expected: Column | str | None = None) -> DataFrame:
    """Rows of raw track files: (path, track, seq, t, v, value_class, parse_status).

    Header ``Time,<track>``; ``seq`` is the row order of the file.  A blank value
    is missing, a non-finite one is null and classed.  Bad rows carry a status
    instead of stopping the read.  ``expected`` is the track a file must name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]"))
    lines = files.select("path", "content").mapInPandas(_decode_files, _LINES)
    t, v = F.trim("raw_t").try_cast("double"), F.col("raw_v").try_cast("double")
    wanted = F.lit(True) if expected is None else F.col("name").eqNullSafe(F.lit(expected) if isinstance(expected, str) else expected)
    status = (F.when(F.col("error").isNotNull(), F.col("error")).when((F.col("head") != "Time") | F.col("name").isNull(), "bad_header").when(~wanted, "unexpected_track")
              .when(F.col("fields") < 2, "short_row").when(t.isNull(), "invalid_timestamp").when(~is_finite(t), "nonfinite_timestamp")
              .when((F.col("raw_v") != "") & v.isNull(), "invalid_value").otherwise("ok"))
    kind = F.when(F.col("raw_v") == "", "missing").when(is_finite(v), "finite").otherwise("nonfinite")
    return lines.select(
        "path", F.col("name").alias("track"), "seq", t.alias("t"), F.when(is_finite(v), v).alias("v"),
        F.when(status == "ok", kind).alias("value_class"), status.alias("parse_status"))


# --- partitioned, array and log tables ------------------------------------------------

def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "errorifexists", fmt: str = "csv") -> None:
    """Large case x candidate table, one folder per candidate, gzip CSV or parquet."""
    w = df.write.mode(mode).partitionBy(by)
    w.options(header="true", compression="gzip", nullValue="").csv(path) if fmt == "csv" else w.parquet(path)


def read_partition(spark: SparkSession, path: str, by: str, value: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Rows of one candidate; only its folder is listed and read."""
    r = spark.read.schema(schema)
    return (r.options(header="true", nullValue="").csv(path) if fmt == "csv" else r.parquet(path)).where(F.col(by) == value)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_split(spark: SparkSession, path: str, splits: DataFrame, split: str, columns: Sequence[str], casts: Mapping[str, str]) -> DataFrame:
    """Rows of one split only: other splits are dropped by a semi-join before any cell is parsed."""
    raw = read_snapshot(spark, path, columns)
    keep = splits.where(F.col("split") == split).select(F.col("caseid").cast("string").alias("caseid"))
    return raw.join(keep, "caseid", "left_semi").select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in columns])
