"""Integrity queries on events, conversations and the parquet files themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.operators import integrity as ig, stores
from tracksieve.plans import fixtures as fx
from tracksieve.plans.inventories import TASK_CTE, tasks
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r
from tracksieve.session import cut_lineage


def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return e.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("task"), F.col("event_id").alias("seq"), "event_type",
                    F.when(k < 70, "complete").otherwise("failed").alias("status"), ((k >= 70) & (k < 90)).alias("retryable"), "value", micros.alias("ts_micros"),
                    F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split"))


LG = dict(lg="""SELECT user_id||'|'||event_type AS task, event_id AS seq, event_type, value, CASE WHEN (props->>'$.k')::INT<70 THEN 'complete' ELSE 'failed' END AS status,
  (props->>'$.k')::INT>=70 AND (props->>'$.k')::INT<90 AS retryable, epoch_us(ts) AS us, CASE WHEN user_id%5=0 THEN 'test' ELSE 'train' END AS split FROM events""")


def sql(body: str, *needs: str, **more: str) -> str:
    return fx.sql(body, *needs, **LG, **more)


FOLD = """SELECT task, attempts, last_seq, s AS last_status, CASE WHEN s='complete' THEN 'skip' WHEN NOT r THEN 'stop_final' WHEN attempts>=3 THEN 'exhausted' ELSE 'retry' END AS next_action
  FROM (SELECT task, count(*)::BIGINT AS attempts, max(seq) AS last_seq, arg_max(status, seq) AS s, arg_max(retryable, seq) AS r FROM lg GROUP BY 1)"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    amb = tasks(spark, d).where(F.col("status") == "ambiguous").select(F.concat_ws("|", F.col("caseid").cast("string"), "tname").alias("task"))
    return ig.failure_events(ledger(spark, d), amb)


FAILURE_SQL = sql("""SELECT task, seq, 'ledger' AS source, CASE WHEN retryable THEN 'retryable_failure' ELSE 'final_failure' END AS failure_type FROM lg WHERE status<>'complete'
  UNION ALL SELECT caseid||'|'||tname, NULL, 'structure', 'ambiguous_multiple_tids' FROM ts WHERE status='ambiguous'""", "tk", ts=TASK_CTE)


def accesses(spark: SparkSession, d: str) -> DataFrame:
    l = ledger(spark, d).withColumnRenamed("event_type", "track")
    names = ("click", "view", "error", "signup", "purchase", "never")
    want = fx.table(spark, d, "events").select(F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split")).distinct().select(
        "split", F.explode(F.array(*[F.lit(n) for n in names])).alias("track"))
    return ig.access_accounting(l, want)


ACCESS_SQL = sql("""SELECT e.split, e.track, count(seq)::BIGINT AS accesses, count(*) FILTER (WHERE status<>'complete')::BIGINT AS failures, min(seq) FILTER (WHERE status<>'complete') AS first_failure,
  e.split='test' AND count(seq)>0 AS forbidden FROM (SELECT split, unnest(['click','view','error','signup','purchase','never']) AS track FROM (SELECT DISTINCT split FROM lg)) e LEFT JOIN lg ON lg.split=e.split AND lg.event_type=e.track GROUP BY 1,2""")


def operations(spark: SparkSession, d: str) -> DataFrame:
    return _r(ig.operations_summary(ledger(spark, d), "value", "event_type"))


OPS_SQL = sql("""SELECT event_type, any_value(n)::BIGINT AS events, round(count(*) FILTER (WHERE status<>'complete')/count(*),6)+0.0 AS failure_rate, count(*) FILTER (WHERE retryable)::BIGINT AS retries,
  round((max(us)-min(us))/1e6,6)+0.0 AS span_seconds, round(median(value),6)+0.0 AS median, round(max(value) FILTER (WHERE r=round_even(0.9*(n-1),0)+1),6)+0.0 AS p90
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM lg) GROUP BY 1""")


def turns(spark: SparkSession, d: str) -> DataFrame:
    t = fx.table(spark, d, "conversations")
    return t.select("conv_id", F.concat_ws("/", F.col("turn").cast("string"), "role").alias("name"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha"))


def prints(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws("\t", "name", F.col("bytes").cast("string"), "sha")
    return ig.tree_fingerprint(turns(spark, d), ["conv_id"], "name", line)


PRINT_CTES = dict(
    tn="SELECT conv_id, turn||'/'||role AS name, turn||'/'||role||chr(9)||octet_length(encode(text))||chr(9)||sha256(text) AS line FROM conversations",
    nu="SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY sha256(name))-1 AS r FROM tn",
    **fx.tree("ft", "nu", "conv_id", "r", "line"), fp="SELECT k AS conv_id, ids, sha256 FROM ft")


def root_print(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of the whole store from the fingerprints of its directories."""
    p = prints(spark, d).withColumn("store", F.lit("conversations"))
    return ig.tree_fingerprint(p, ["store"], "conv_id", F.concat_ws("\t", F.col("conv_id").cast("string"), "sha256"))


ROOT_SQL = sql("SELECT k AS store, ids, sha256 FROM rt", **PRINT_CTES,
               rl="SELECT 'conversations' AS store, conv_id||chr(9)||sha256 AS line, row_number() OVER (ORDER BY sha256(conv_id::VARCHAR))-1 AS r FROM fp",
               **fx.tree("rt", "rl", "store", "r", "line"))


def store_verify(spark: SparkSession, d: str) -> DataFrame:
    """A store index with damaged, missing, duplicated and incomplete rows against recomputed fingerprints."""
    p = prints(spark, d).select("conv_id", F.col("sha256").alias("fingerprint"))
    k = F.col("conv_id")
    i = p.where(k % 11 != 0).select("conv_id", F.when(k % 7 == 0, F.reverse("fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"), (k % 13 != 0).alias("complete"))
    i = i.unionByName(i.where(k % 17 == 0)).unionByName(p.where(k % 19 == 0).select((-k - 1).alias("conv_id"), "fingerprint", F.lit(True).alias("complete")))
    return ig.verify_store(i, p, "conv_id")


STORE_SQL = """SELECT conv_id, CASE WHEN conv_id%11=0 THEN 'not_indexed' WHEN conv_id%17=0 THEN 'duplicate_index_row' WHEN conv_id%13=0 THEN 'incomplete' WHEN conv_id%7=0 THEN 'fingerprint_mismatch' ELSE 'ok' END AS verdict
  FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT -conv_id-1, 'payload_missing' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id%19=0"""


def ledger_init(spark: SparkSession, d: str) -> DataFrame:
    fold = ig.ledger_fold(ledger(spark, d))
    e = fx.table(spark, d, "events")
    req = e.select(F.concat_ws("|", F.col("user_id").cast("string"), F.lit("view")).alias("task")).unionByName(e.select(F.concat_ws("|", (F.col("user_id") + 100).cast("string"), "event_type").alias("task")))
    return ig.initialise_ledger(req, fold.select("task", F.col("last_status").alias("status")))


INIT_SQL = sql(f"""SELECT coalesce(q.task, f.task) AS task, CASE WHEN q.task IS NULL THEN 'stale' ELSE coalesce(last_status,'pending') END AS status
  FROM (SELECT user_id||'|view' AS task FROM events UNION SELECT (user_id+100)||'|'||event_type FROM events) q FULL JOIN ({FOLD}) f ON q.task=f.task""")


def verify_only(spark: SparkSession, d: str) -> DataFrame:
    """Recomputed fold against a published copy with changed, lost and doubled rows."""
    now = ig.ledger_fold(ledger(spark, d)).select("task", "attempts", "next_action")
    published = now.where(F.col("attempts") % 7 != 0).withColumn("next_action", F.when(F.col("task").endswith("|view"), "changed").otherwise(F.col("next_action")))
    return ig.table_difference(now, published.unionByName(published.where(F.col("attempts") % 5 == 0)))


VERIFY_SQL = sql("""SELECT task, attempts, next_action, sum(x)::BIGINT AS surplus FROM (SELECT task, attempts, next_action, 1 AS x FROM fo UNION ALL SELECT task, attempts, next_action, -1 FROM pb
  UNION ALL SELECT task, attempts, next_action, -1 FROM pb WHERE attempts%5=0) GROUP BY 1,2,3 HAVING sum(x)<>0""", fo=FOLD,
                 pb="SELECT task, attempts, CASE WHEN task LIKE '%|view' THEN 'changed' ELSE next_action END AS next_action FROM fo WHERE attempts%7<>0")

SNAPSHOT_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in SNAPSHOT_TABLES:
        s = ig.snapshot(name, fx.table(spark, d, name))
        out = s if out is None else out.unionByName(s)
    return out


SNAPSHOT_SQL = " UNION ALL ".join(f"""SELECT '{t}' AS source, (SELECT count(*) FROM {t})::BIGINT AS rows, count(*)::BIGINT AS columns, sha256(string_agg(column_name, chr(10) ORDER BY ordinal_position)) AS field_sha256,
  'complete' AS status FROM information_schema.columns WHERE table_name='{t}'""" for t in SNAPSHOT_TABLES)


def seals(spark: SparkSession, d: str) -> DataFrame:
    s = ledger(spark, d).select("task", "seq", "status", "retryable", F.col("ts_micros").alias("created_at"))
    return ig.seal_hash(s, ["created_at"]).select("task", "seq", "seal_sha256")


SEAL_SQL = sql("""SELECT task, seq, sha256('{"retryable":'||retryable||',"seq":'||seq||',"status":"'||status||'","task":"'||task||'"}') AS seal_sha256 FROM lg""")


def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    """The tables of the run, a file or a folder of files each, against a manifest of themselves with one damaged entry."""
    found = cut_lineage(stores.entry_hashes(spark, d))
    manifest = found.withColumn("sha256", F.when(F.col("name") == "orders.parquet", F.lit("0")).otherwise(F.col("sha256"))).where(F.col("name") != "region.parquet")
    return ig.compare_files(found, manifest)


FILES_SQL = "SELECT * FROM (VALUES " + ",".join(f"('{t}.parquet','{'checksum_mismatch' if t == 'orders' else 'unlisted' if t == 'region' else 'ok'}')" for t in (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()) + ") t(name, verdict)"

QUERIES = {
    "ledger_fold": Query(lambda s, d: ig.ledger_fold(ledger(s, d)), sql(FOLD)),
    "failure_events": Query(failures, FAILURE_SQL),
    "access_accounting": Query(accesses, ACCESS_SQL),
    "ops_summary": Query(operations, OPS_SQL),
    "tree_fingerprint": Query(prints, sql("SELECT conv_id, ids, sha256 FROM fp", **PRINT_CTES)),
    "root_fingerprint": Query(root_print, ROOT_SQL),
    "store_verify": Query(store_verify, STORE_SQL),
    "ledger_init": Query(ledger_init, INIT_SQL),
    "verify_only": Query(verify_only, VERIFY_SQL),
    "snapshot_stats": Query(snapshots, SNAPSHOT_SQL),
    "seal_hashes": Query(seals, SEAL_SQL),
    "file_checksums": Query(file_checksums, FILES_SQL),
}
