"""Round trips through the file sources: driver rows are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksieve.operators import features as ft
from tracksieve.plans import fixtures as fx
from tracksieve.plans import integrity_plans as ip
from tracksieve.plans import schedules, sweeps
from tracksieve.plans.registry import Query
from tracksieve.sources import publish as pb
from tracksieve.session import shared_dir
from tracksieve.sources import files as fs


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the folder all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


MANIFEST = T.StructType([
    T.StructField("caseid", T.LongType(), False), T.StructField("status", T.StringType(), False), T.StructField("value", T.DoubleType(), True),
    T.StructField("retryable", T.BooleanType(), False), T.StructField("tracks", T.ArrayType(T.StringType()), True),
    T.StructField("sizes", T.MapType(T.StringType(), T.LongType()), True)])


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return fx.table(spark, d, "events").select(
        k.alias("caseid"), F.concat(F.col("event_type"), F.when(k % 7 == 0, F.lit(', "quoted"')).otherwise(F.lit(""))).alias("status"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"), (k % 3 == 0).alias("retryable"),
        F.array(F.col("event_type"), F.lit("b|c")).alias("tracks"), F.create_map(F.col("event_type"), k).alias("sizes"))


def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "manifest")
    fs.write_manifest(_manifest(spark, d), path, MANIFEST)
    back = fs.read_manifest(spark, path, MANIFEST)
    return back.select("caseid", "status", "value", "retryable", F.array_join("tracks", "+").alias("tracks"), F.element_at(F.map_values("sizes"), 1).alias("size"))


MANIFEST_SQL = """SELECT event_id AS caseid, event_type||CASE WHEN event_id%7=0 THEN ', "quoted"' ELSE '' END AS status, CASE WHEN event_id%5<>0 THEN value END AS value,
  event_id%3=0 AS retryable, event_type||'+b|c' AS tracks, event_id AS size FROM events"""


def _write_tracks(spark: SparkSession, d: str) -> str:
    """Raw track files: one gzip file per (track, shard of cases), rows in recorded order."""
    path = scratch(spark, "tracks")
    s = fx.signal(spark, d).where(F.col("track") == fx.SIG).withColumn("shard", F.col("caseid") % 16)
    odd = F.when(F.col("seq") % 97 == 0, "inf").when(F.col("seq") % 89 == 0, "oops").otherwise(F.coalesce(F.round("v", 6).cast("string"), F.lit("")))
    rows = s.select("shard", "seq", F.when(F.col("seq") % 101 == 0, "late").otherwise(F.col("t").cast("bigint").cast("string")).alias("Time"), odd.alias(fx.SIG))
    rows.repartition("shard").sortWithinPartitions("shard", "seq").drop("seq").write.partitionBy("shard").options(header="true", compression="gzip", emptyValue="").csv(path)
    return path


def track_decode(spark: SparkSession, d: str) -> DataFrame:
    t = fs.read_tracks(spark, _write_tracks(spark, d), fx.SIG)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint")
    return t.groupBy(shard.alias("shard"), "parse_status", F.coalesce("value_class", F.lit("-")).alias("value_class")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("seq")).alias("order_sum"), F.round(F.sum("v"), 4).alias("total"))


TRACK_SQL = fx.sql("""SELECT shard, parse_status, CASE WHEN parse_status='ok' THEN vc ELSE '-' END AS value_class, count(*)::BIGINT AS rows, sum(r)::BIGINT AS order_sum, round(sum(CASE WHEN vc='finite' THEN v END),4) AS total FROM (
  SELECT *, CASE WHEN seq%101=0 THEN 'invalid_timestamp' WHEN seq%97<>0 AND seq%89=0 THEN 'invalid_value' ELSE 'ok' END AS parse_status,
   CASE WHEN seq%97=0 THEN 'nonfinite' WHEN seq%89=0 THEN 'bad' WHEN v IS NULL THEN 'missing' ELSE 'finite' END AS vc FROM (
   SELECT caseid%16 AS shard, seq, round(v,6) AS v, row_number() OVER (PARTITION BY caseid%16 ORDER BY seq) AS r FROM sg WHERE track='SIG')) GROUP BY 1,2,3""", "sg")


def pruned_candidate_read(spark: SparkSession, d: str) -> DataFrame:
    """All candidates are written once; one is read back from its own folder."""
    path, c = scratch(spark, "candidates"), sweeps.counts(spark, d).drop("rule", "signal_cap", "rate_cap")
    fs.write_partitioned(c, path, "candidate_id")
    return fs.read_partition(spark, path, "candidate_id", "ge_50__sig172800s__rate432000s", c.schema)


PRUNED_SQL = sweeps.sweep_sql("SELECT * EXCLUDE (rule, signal_cap, rate_cap) FROM cnt WHERE candidate_id='ge_50__sig172800s__rate432000s'")


def log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "log")
    rows = ip.ledger(spark, d).select("task", "seq", "status", "retryable", "value")
    fs.write_log(rows, path)
    return fs.read_log(spark, path, rows.schema)


def array_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Chunked array payload through parquet and back to events."""
    path = scratch(spark, "payload")
    ft.template_payload(schedules.template(spark, d), schedules.CHUNK).write.parquet(path)
    return spark.read.parquet(path).select("caseid", F.explode("events").alias("e")).select("caseid", "e.*")


def split_scan(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the test split; the text of other splits is never parsed."""
    path = scratch(spark, "profiles")
    l = fx.linkage_source(spark, d)
    l.select(F.col("caseid").cast("string").alias("caseid"), "sex", F.when(F.col("caseid") % 5 == 0, F.round("age", 3).cast("string")).otherwise("unreadable").alias("age")).write.options(header="true").csv(path)
    splits = l.select("caseid", F.when(F.col("caseid") % 5 == 0, "test").otherwise("train").alias("split"))
    return fs.read_split(spark, path, splits, "test", ("caseid", "sex", "age"), {"caseid": "bigint", "age": "double"})


def snapshot_file(spark: SparkSession, d: str) -> DataFrame:
    """All-text snapshot of a table with its row count and total text length."""
    path = scratch(spark, "snapshot")
    cols = ("o_orderkey", "o_orderstatus", "o_orderpriority")
    fx.table(spark, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in cols]).write.options(header="true", compression="gzip").csv(path)
    s = fs.read_snapshot(spark, path, cols)
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("o_orderkey") + F.length("o_orderpriority")).cast("bigint").alias("characters"))


COLUMNS = ("o_orderkey", "o_orderstatus", "o_totalprice")


def publish_gates(spark: SparkSession, d: str) -> DataFrame:
    """Two attempts to publish the orders: a clean one, then one with faults; the gates of each and the rows visible after it."""
    path = scratch(spark, "published")
    o = fx.table(spark, d, "orders").select(*COLUMNS)
    k = F.col("o_orderkey")
    bad = o.select(F.when(k % 1009 == 0, k + 1).otherwise(k).alias("o_orderkey"), F.when(k % 77 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
                   F.when(k % 100 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    out = []
    for attempt, rows in (("clean", o), ("faulty", bad)):
        gates = pb.publish(rows, path, COLUMNS, rows=o.count(), not_null=("o_orderstatus",), finite=("o_totalprice",), key=("o_orderkey",), cover=o)
        seen = pb.published(spark, path).agg(F.count(F.lit(1)), F.count_if(F.isnan("o_totalprice"))).first()
        out += [(attempt, *g, *seen) for g in gates]
    return spark.createDataFrame(out, "attempt string, gate string, observed bigint, passed boolean, visible_rows bigint, visible_nan bigint")


PUBLISH_SQL = """WITH b AS (SELECT CASE WHEN o_orderkey%1009=0 THEN o_orderkey+1 ELSE o_orderkey END AS k, o_orderkey%77=0 OR o_orderstatus IS NULL AS n, o_orderkey%100=0 AS f FROM orders),
 n AS (SELECT count(*)::BIGINT AS n FROM orders), x AS (SELECT k, count(*) AS c FROM b GROUP BY 1), j AS (SELECT c, x.k AS a, o_orderkey AS w FROM x FULL JOIN orders ON x.k=o_orderkey),
 g AS (SELECT 'clean' AS attempt, unnest([{'gate':'column_order','observed':0::BIGINT}, {'gate':'rows','observed':n}, {'gate':'null_o_orderstatus','observed':0}, {'gate':'non_finite_o_totalprice','observed':0},
    {'gate':'repeated_keys','observed':0}, {'gate':'missing_keys','observed':0}, {'gate':'extra_keys','observed':0}], recursive:=true) FROM n
  UNION ALL SELECT 'faulty', unnest([{'gate':'column_order','observed':0::BIGINT}, {'gate':'rows','observed':n}, {'gate':'null_o_orderstatus','observed':(SELECT count(*) FROM b WHERE n)}, {'gate':'non_finite_o_totalprice','observed':(SELECT count(*) FROM b WHERE f)},
    {'gate':'repeated_keys','observed':(SELECT count(*) FROM j WHERE c>1)}, {'gate':'missing_keys','observed':(SELECT count(*) FROM j WHERE a IS NULL)}, {'gate':'extra_keys','observed':(SELECT count(*) FROM j WHERE w IS NULL)}], recursive:=true) FROM n)
 SELECT attempt, gate, observed, gate='rows' OR observed=0 AS passed, n AS visible_rows, 0::BIGINT AS visible_nan FROM g, n"""

QUERIES = {
    "publish_gates": Query(publish_gates, PUBLISH_SQL),
    "manifest_roundtrip": Query(manifest_roundtrip, MANIFEST_SQL),
    "track_decode": Query(track_decode, TRACK_SQL),
    "pruned_candidate_read": Query(pruned_candidate_read, PRUNED_SQL),
    "log_roundtrip": Query(log_roundtrip, ip.sql("SELECT task, seq, status, retryable, value FROM lg")),
    "array_roundtrip": Query(array_roundtrip, fx.sql("SELECT caseid, t, in_range, quality FROM tp", "dd", "cs", **schedules.TPL)),
    "split_scan": Query(split_scan, fx.sql("SELECT caseid, sex, round(age,3) AS age FROM lk WHERE caseid%5=0", "lk")),
    "snapshot_file": Query(snapshot_file, "SELECT o_orderstatus, count(*)::BIGINT AS rows, sum(length(o_orderkey::VARCHAR)+length(o_orderpriority))::BIGINT AS characters FROM orders GROUP BY 1"),
}
