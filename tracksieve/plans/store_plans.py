"""Store queries: orders written as text files by month, some of them spoilt, against a manifest made from the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.operators import stores
from tracksieve.operators.checksums import tree_checksum
from tracksieve.operators.ordered import SEG, ranked
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query
from tracksieve.session import cut_lineage, shared_dir

SEGMENT = 1 << 16


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(month, number, key, status, line): an order is one line of its month's file."""
    o = fx.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.substring(day, 1, 7).alias("month"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("number"), F.col("o_orderkey").alias("key"),
                    F.concat_ws("|", "o_orderstatus", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), day).alias("line"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(month, bytes, lines, sha256) from the rows, before any file exists."""
    rows = lines(spark, d).withColumn(SEG, F.floor(F.col("key") / SEGMENT))
    numbered = ranked(rows, ["month"], ["key"], "_r").select("month", (F.col("_r") - 1).alias("_no"), F.sha2(F.col("line").cast("binary"), 256).alias("_h"))
    sizes = rows.groupBy("month").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    return tree_checksum(numbered, "_no", keys=["month"], text="_h").join(sizes, "month").select("month", "bytes", F.col("ids").alias("lines"), "sha256")


def spoilt(rows: DataFrame) -> DataFrame:
    """By month in turn: damaged, truncated, left partial, lost, copied, and two that stay as they are."""
    kind, tenth = F.pmod("number", F.lit(7)), F.pmod("key", F.lit(10)) == 0
    kept = rows.where((kind != 3) & ~((kind == 1) & tenth))
    kept = kept.withColumn("line", F.when((kind == 0) & tenth, F.overlay("line", F.lit("X"), F.lit(1))).otherwise(F.col("line")))
    kept = kept.withColumn("month", F.when(kind == 2, F.concat("month", F.lit(".partial"))).otherwise(F.col("month")))
    return kept.unionByName(kept.where(kind == 4).withColumn("month", F.concat("month", F.lit("-copy"))))


def written(spark: SparkSession, rows: DataFrame, mode: str = "errorifexists", root: str | None = None) -> str:
    """The folder with one text file for every month, its lines by key."""
    root = root or f"{shared_dir(spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    rows.repartition("month").sortWithinPartitions("month", "key").select("month", F.col("line").alias("value")).write.partitionBy("month").mode(mode).text(root)
    return root


def found(spark: SparkSession, root: str) -> DataFrame:
    folder = F.regexp_extract("name", r"^month=([^/]+)/", 1)
    return stores.content_hashes(spark, root).select(
        F.regexp_replace(folder, r"\.partial$", "").alias("month"), F.rlike(folder, F.lit(r"\.partial$")).alias("partial"), "bytes", "lines", "sha256")


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, written(spark, lines(spark, d))).drop("partial")


def store_audit(spark: SparkSession, d: str) -> DataFrame:
    listed = cut_lineage(manifest(spark, d))
    return stores.audit(found(spark, written(spark, spoilt(lines(spark, d)))), listed, "month")


def states(spark: SparkSession, d: str) -> DataFrame:
    """The store before a reading job, after it, and after another job has added the partial months."""
    rows = lines(spark, d).where(F.pmod("number", F.lit(7)) != 2)
    root = written(spark, rows)
    moments = {"before": cut_lineage(stores.store_state(spark, root))}
    cut_lineage(stores.content_hashes(spark, root))
    moments["read"] = cut_lineage(stores.store_state(spark, root))
    written(spark, spoilt(lines(spark, d)).where(F.pmod("number", F.lit(7)) == 2), "append", root)
    moments["added"] = cut_lineage(stores.store_state(spark, root))
    first = moments["before"].select(F.col("sha256").alias("_first"))
    out = None
    for name, state in moments.items():
        s = state.select(F.lit(name).alias("moment"), "files", "bytes", "partial_files", "sha256")
        out = s if out is None else out.unionByName(s)
    return out.withColumn("unchanged", F.col("sha256") == first.scalar()).drop("sha256")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Stores of each kind of month, one of which was never written."""
    rows = spoilt(lines(spark, d))
    kind = F.pmod("number", F.lit(7))
    out = None
    for name, part in {"damaged": rows.where(kind == 0), "truncated": rows.where(kind == 1), "copied": rows.where(kind == 4), "plain": rows.where(kind > 4), "lost": None}.items():
        root = f"{shared_dir(spark).rstrip('/')}/none-{uuid.uuid4().hex}" if part is None else written(spark, part)
        s = stores.snapshot_source(spark, name, root)
        out = s if out is None else out.unionByName(s)
    return out.drop("content_sha256", "read_at", "seconds")  # paths and clocks differ by run


LN = dict(ln="""SELECT strftime(o_orderdate,'%Y-%m') AS month, year(o_orderdate)*12+month(o_orderdate) AS m, o_orderkey AS key,
  o_orderstatus||'|'||o_orderkey||'|'||o_custkey||'|'||strftime(o_orderdate,'%Y-%m-%d') AS line FROM orders""")
HASH_SQL = fx.sql("SELECT month, b::BIGINT AS bytes, ids AS lines, sha256 FROM ft JOIN (SELECT month, sum(octet_length(encode(line))+1) AS b FROM ln GROUP BY 1) ON k=month", **LN,
                  nu="SELECT month, sha256(line) AS h, row_number() OVER (PARTITION BY month ORDER BY key)-1 AS r FROM ln", **fx.tree("ft", "nu", "month", "r", "h"))
AUDIT_SQL = fx.sql("""SELECT month, CASE WHEN m%7=3 OR (m%7=1 AND n=t) THEN 'missing' WHEN m%7=2 THEN 'partial' WHEN m%7=1 AND t>0 THEN 'truncated' WHEN m%7=0 AND t>0 THEN 'damaged' ELSE 'ok' END AS verdict
  FROM (SELECT month, m, count(*) AS n, count(*) FILTER (WHERE key%10=0) AS t FROM ln GROUP BY 1,2) UNION ALL SELECT DISTINCT month||'-copy', 'unlisted' FROM ln WHERE m%7=4""", **LN)
STATE_SQL = fx.sql("""SELECT moment, count(DISTINCT month)::BIGINT AS files, sum(octet_length(encode(line))+1)::BIGINT AS bytes, count(DISTINCT month) FILTER (WHERE m%7=2)::BIGINT AS partial_files,
  moment<>'added' AS unchanged FROM ln, (SELECT unnest(['before','read','added']) AS moment) WHERE m%7<>2 OR moment='added' GROUP BY 1""", **LN)
SNAPSHOT_SQL = fx.sql("""SELECT source, 'complete' AS status, (count(DISTINCT month)*any_value(times))::BIGINT AS files, (sum(octet_length(encode(line))+1)*any_value(times))::BIGINT AS bytes,
  (count(*)*any_value(times))::BIGINT AS rows, 1::BIGINT AS columns, NULL::VARCHAR AS failure FROM (SELECT *, CASE m%7 WHEN 0 THEN 'damaged' WHEN 1 THEN 'truncated' WHEN 4 THEN 'copied' ELSE 'plain' END AS source,
  CASE WHEN m%7=4 THEN 2 ELSE 1 END AS times FROM ln WHERE m%7 NOT IN (2,3) AND NOT (m%7=1 AND key%10=0)) GROUP BY 1
  UNION ALL SELECT 'lost', 'failed', NULL, NULL, NULL, NULL, 'PATH_NOT_FOUND'""", **LN)

QUERIES = {
    "content_hashes": Query(hashes, HASH_SQL),
    "store_audit": Query(store_audit, AUDIT_SQL),
    "store_states": Query(states, STATE_SQL),
    "source_snapshots": Query(snapshots, SNAPSHOT_SQL),
}
