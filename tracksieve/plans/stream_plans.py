"""Streaming queries: driver rows as a stream of several batches, drained with availableNow, then read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.plans import alignment as al, fixtures as fx
from tracksieve.plans import integrity_plans as ip
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r
from tracksieve.plans.source_plans import scratch
from tracksieve.session import cut_lineage
from tracksieve.streaming import streams as st


PARTS = 5
BASE = 1704067200.0  # event times count from 2024-01-01


def _as_stream(spark: SparkSession, rows: DataFrame, name: str, order: str, close: bool = False) -> DataFrame:
    """The rows as a stream of ``PARTS`` parts that come one after the other, roughly in ``order``, a batch each."""
    path, files = scratch(spark, name), max(2, spark.sparkContext.defaultParallelism)
    rows = cut_lineage(rows)  # read for the cuts and by every part
    cuts = rows.select(F.col(order).cast("double").alias("_x")).agg(F.min("_x"), F.max("_x")).first()
    place = F.least(F.floor((F.col(order).cast("double") - cuts[0]) / max(cuts[1] - cuts[0], 1.0) * PARTS), F.lit(PARTS - 1))
    for part in range(PARTS):
        rows.where(place == part).repartition(files).write.mode("append").parquet(path)
    if close:
        st.close_source(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _appended(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = scratch(spark, f"{name}-out")
    st.append_to_table(stream, out, scratch(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def acceptance(spark: SparkSession, d: str) -> DataFrame:
    e = al.exact_ts_join(spark, d).select(
        "caseid", F.col("t").cast("bigint").alias("seq"), F.timestamp_seconds(F.col("t") + BASE).alias("ts"), "t", "v", "quality")
    s = st.acceptance_stream(_as_stream(spark, e, "events", "t", close=True), al.SIGNAL_CAP, al.AGE_CLIP, delay="7 days", base=BASE)
    return _r(_appended(spark, s, "acceptance"))


ACCEPTANCE_SQL = fx.sql(f"""SELECT caseid, t::BIGINT AS seq, t, CASE WHEN sh THEN gv ELSE 0 END AS value, CASE WHEN sh THEN 1.0 ELSE 0.0 END::DOUBLE AS mask, CASE WHEN sh THEN least(t-gt,{al.AGE_CLIP}) ELSE 0 END::DOUBLE AS age,
  CASE WHEN sh THEN 'available' WHEN gt IS NULL OR t>gt THEN why ELSE 'stale_beyond_cap' END AS reason
 FROM (SELECT r.*, g.t AS gt, g.v AS gv, coalesce(r.t-g.t<={al.SIGNAL_CAP},false) AS sh FROM rw r ASOF LEFT JOIN (SELECT * FROM rw WHERE why='available') g ON r.caseid=g.caseid AND r.t>=g.t)""", "dd",
                        rw="""SELECT a.caseid, a.t, round(a.v,6)+0.0 AS v, CASE WHEN NOT round(a.v,6) BETWEEN 0 AND 100 THEN 'signal_out_of_range' WHEN q.v IS NULL THEN 'quality_missing_exact_timestamp' WHEN q.v<50 THEN 'quality_below_threshold' ELSE 'available' END AS why
                          FROM dd a LEFT JOIN dd q ON a.caseid=q.caseid AND a.t=q.t AND q.track='QLT' WHERE a.track='SIG'""")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = ip.ledger(spark, d).select("task", "seq", "status", "retryable")
    out = scratch(spark, "ledger-out")
    st.add_parts(_as_stream(spark, rows, "ledger", "seq"), st.ledger_parts, out, scratch(spark, "ledger-state"))
    return st.ledger_table(spark.read.parquet(out))


LEDGER_SQL = ip.sql("SELECT task, count(*)::BIGINT AS attempts, max(seq) AS last_seq, arg_max(status,seq) AS last_status, arg_max(retryable,seq) AS last_retryable FROM lg GROUP BY 1")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").select(F.col("user_id").alias("caseid"), F.col("ts").cast("timestamp").alias("ts"), "value")
    s = _appended(spark, st.session_stream(_as_stream(spark, rows, "sessions", "ts", close=True), F.col("value") > 20, "6 hours", "7 days"), "sessions")
    return s.select("caseid", "rows", (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("span_micros"))


SESSION_SQL = """SELECT caseid, count(*)::BIGINT AS rows, (max(us)-min(us))::BIGINT AS span_micros FROM (SELECT *, sum(CASE WHEN us-p<=21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY caseid ORDER BY us, event_id) AS g FROM (
   SELECT user_id AS caseid, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value>20)) GROUP BY caseid, g"""

QUERIES = {
    "stream_acceptance": Query(acceptance, ACCEPTANCE_SQL),
    "stream_ledger": Query(ledger, LEDGER_SQL),
    "stream_sessions": Query(sessions, SESSION_SQL),
}
