"""Domain views over the driver tables, once as DataFrames and once as SQL text.

The SQL side is an independent statement of the same rule and serves only as
oracle.  ``FixtureSet`` reads parquet lazily; nothing is cached or collected.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Grid step, window margins and rule parameters of the driver-table studies (seconds).
STEP = 21600.0
HISTORY = 6
TARGET = 3
SIGNAL_CAPS = (86400, 172800, 259200)
RATE_CAPS = (172800, 259200, 432000, 604800, 864000)
RULES = {"none": None, "ge_20": 20.0, "ge_50": 50.0, "ge_80": 80.0}
MIN_WINDOWS = (5, 10, 20, 40, 80)
SIG, RATE_A, RATE_B, EXP, QLT = "SIG", "RATE_A", "RATE_B", "EXP", "QLT"
PRIMARY = (SIG, RATE_A, RATE_B)
CONDITIONS = ("P0S0", "P1S0", "P0S1", "P1S1")


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The (lazy) scan of one driver table; remembered so its footer is read once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: Column) -> Column:
    """Whole seconds since 2024-01-01 UTC, whatever the session time zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), ts.cast("timestamp_ntz")).cast("bigint")


def signal(spark: SparkSession, sf_dir: str, *, nan: bool = False, quality: bool = False) -> DataFrame:
    """(caseid, track, seq, t, v): one row per event; ``seq`` is the recorded order."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id")
    kind = F.col("event_type")
    track = (
        F.when(kind.isin("purchase", "signup"), SIG).when(kind == "click", RATE_A)
        .when(kind == "error", RATE_B).when(kind == "view", EXP)
    )
    shifted = _seconds(F.col("ts")) - F.when(seq % 17 == 0, 86400).otherwise(0)
    v = F.when((seq % 11 == 0) | (seq % 23 == 0), F.lit(None).cast("double"))
    if nan:
        v = v.when(seq % 29 == 0, F.lit(float("nan")))
    v = v.when(track == SIG, F.col("value") / 3).otherwise(F.col("value") - 20)
    rows = e.select(
        F.col("user_id").alias("caseid"), track.alias("track"), seq.alias("seq"),
        (F.floor(shifted / STEP) * STEP).cast("double").alias("t"), v.alias("v"))
    if not quality:
        return rows
    # Quality rows share the scan: a signal row explodes into itself and its quality value.
    own = F.struct(F.col("track"), F.col("v"))
    extra = F.struct(F.lit(QLT).alias("track"), ((F.col("seq") * 37) % 100).cast("double").alias("v"))
    pair = F.when((F.col("track") == SIG) & (F.col("seq") % 5 != 0), F.array(own, extra)).otherwise(F.array(own))
    return rows.select("caseid", "seq", "t", F.explode(pair).alias("_r")).select(
        "caseid", F.col("_r.track").alias("track"), "seq", "t", F.col("_r.v").alias("v"))


def cases(spark: SparkSession, sf_dir: str, *, inverted: bool = False) -> DataFrame:
    """(caseid, w0, w1): the analysis window of each case."""
    w = signal(spark, sf_dir).groupBy("caseid").agg(
        (F.min("t") + 43200).alias("w0"), (F.max("t") - 43200).alias("w1"))
    if inverted:
        flip = F.col("caseid") % 50 == 0
        w = w.select("caseid", F.when(flip, F.col("w1")).otherwise(F.col("w0")).alias("w0"),
                     F.when(flip, F.col("w0")).otherwise(F.col("w1")).alias("w1"))
    return w


def linkage_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their subject and demographics, from orders and customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    male = F.col("c_mktsegment").isin("BUILDING", "FURNITURE", "MACHINERY")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("caseid"), F.col("o_custkey").alias("subjectid"),
        F.when(male, "M").otherwise("F").alias("sex"),
        (18 + (F.col("c_acctbal") + 1000) / 150).alias("age"),
        (150 + F.col("c_custkey") % 50).cast("double").alias("height"),
        (45 + F.col("c_custkey") % 70).cast("double").alias("weight"),
        (1 + F.col("o_orderkey") % 6).cast("string").alias("asa"),
        F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 3 == 0, "Y").otherwise("0").alias("emergency"),
        F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("c_mktsegment")).alias("operation"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track inventory rows (caseid, tname, tid) from lineitem and part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("caseid"), F.col("p_brand").alias("tname"),
        F.col("l_linenumber").cast("string").alias("tid"))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caseid, subjectid, condition_id, m1..m5): part as case, five parts as subject, flags as condition.

    Flag N goes to P0 on even line numbers and to P1 on odd ones.  Metrics are whole numbers, so sums are exact.
    """
    even = F.col("l_linenumber") % 2 == 0
    cond = F.concat(F.when((F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & even), "P0").otherwise("P1"),
                    F.when(F.col("l_linestatus") == "F", "S0").otherwise("S1"))
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("caseid"), cond.alias("condition_id")).agg(
        F.sum("l_quantity").alias("m1"), hundredths("l_extendedprice").alias("m2"), hundredths("l_discount").alias("m3"),
        F.max("l_quantity").alias("m4"), hundredths("l_tax").alias("m5"))
    return g.select("caseid", F.floor(F.col("caseid") / 5).alias("subjectid"), "condition_id", "m1", "m2", "m3", "m4", "m5")


def faulty_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metrics_long`` with a wrong condition, a repeated one, a NaN and a second subject in some cases; all rows stay."""
    k, cond = F.col("caseid"), F.col("condition_id")
    wrong = F.when((k % 83 == 0) & (cond == "P1S1"), "P9S9").when((k % 89 == 0) & (cond == "P0S1"), "P0S0").otherwise(cond)
    return metrics_long(spark, sf_dir).select(
        "caseid", F.when((k % 79 == 0) & (cond == "P0S0"), F.lit(-1)).otherwise(F.col("subjectid")).alias("subjectid"), wrong.alias("condition_id"), "m1", "m2",
        F.when((k % 97 == 0) & (cond == "P1S0"), F.lit(float("nan"))).otherwise(F.col("m3")).alias("m3"), "m4", "m5")


METRICS = ("m1", "m2", "m3", "m4", "m5")


# --- the same views as SQL (oracle side) -------------------------------------

_SIGNAL_SQL = """
SELECT user_id AS caseid,
       CASE WHEN event_type IN ('purchase','signup') THEN 'SIG' WHEN event_type='click' THEN 'RATE_A'
            WHEN event_type='error' THEN 'RATE_B' WHEN event_type='view' THEN 'EXP' END AS track,
       event_id AS seq,
       (floor(((epoch_us(ts)//1000000) - 1704067200 - CASE WHEN event_id%17=0 THEN 86400 ELSE 0 END)/21600.0)*21600)::DOUBLE AS t,
       CASE WHEN event_id%11=0 OR event_id%23=0 THEN NULL {nan}
            WHEN event_type IN ('purchase','signup') THEN value/3 ELSE value-20 END AS v
FROM events"""

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sg": ((), _SIGNAL_SQL.format(nan="")),
    "sgn": ((), _SIGNAL_SQL.format(nan="WHEN event_id%29=0 THEN 'nan'::DOUBLE")),
    "sgq": (("sg",), """SELECT caseid, track, seq, t, v FROM sg UNION ALL
        SELECT caseid, 'QLT', seq, t, ((seq*37)%100)::DOUBLE FROM sg WHERE track='SIG' AND seq%5<>0"""),
    "sgnq": (("sgn",), """SELECT caseid, track, seq, t, v FROM sgn UNION ALL
        SELECT caseid, 'QLT', seq, t, ((seq*37)%100)::DOUBLE FROM sgn WHERE track='SIG' AND seq%5<>0"""),
    "cs": (("sg",), "SELECT caseid, min(t)+43200 AS w0, max(t)-43200 AS w1 FROM sg GROUP BY 1"),
    "csi": (("cs",), """SELECT caseid, CASE WHEN caseid%50=0 THEN w1 ELSE w0 END AS w0,
        CASE WHEN caseid%50=0 THEN w0 ELSE w1 END AS w1 FROM cs"""),
    "lk": ((), """SELECT o_orderkey AS caseid, o_custkey AS subjectid,
        CASE WHEN c_mktsegment IN ('BUILDING','FURNITURE','MACHINERY') THEN 'M' ELSE 'F' END AS sex,
        18+(c_acctbal+1000)/150 AS age, (150+c_custkey%50)::DOUBLE AS height, (45+c_custkey%70)::DOUBLE AS weight,
        (1+o_orderkey%6)::VARCHAR AS asa,
        CASE WHEN o_orderkey%7=0 THEN '' WHEN o_orderkey%3=0 THEN 'Y' ELSE '0' END AS emergency,
        CASE WHEN o_orderkey%11=0 THEN ' ' ELSE c_mktsegment END AS operation
        FROM orders JOIN customer ON o_custkey=c_custkey"""),
    "tk": ((), """SELECT l_orderkey AS caseid, p_brand AS tname, l_linenumber::VARCHAR AS tid
        FROM lineitem JOIN part ON l_partkey=p_partkey"""),
    "mx": ((), """SELECT l_partkey AS caseid, l_partkey//5 AS subjectid,
        (CASE WHEN l_returnflag='A' OR (l_returnflag='N' AND l_linenumber%2=0) THEN 'P0' ELSE 'P1' END)||(CASE WHEN l_linestatus='F' THEN 'S0' ELSE 'S1' END) AS condition_id,
        sum(l_quantity) AS m1, sum(round(l_extendedprice*100)) AS m2, sum(round(l_discount*100)) AS m3, max(l_quantity) AS m4, sum(round(l_tax*100)) AS m5
        FROM lineitem GROUP BY 1,2,3"""),
    "mf": (("mx",), """SELECT caseid, CASE WHEN caseid%79=0 AND condition_id='P0S0' THEN -1 ELSE subjectid END AS subjectid,
        CASE WHEN caseid%83=0 AND condition_id='P1S1' THEN 'P9S9' WHEN caseid%89=0 AND condition_id='P0S1' THEN 'P0S0' ELSE condition_id END AS condition_id,
        m1, m2, CASE WHEN caseid%97=0 AND condition_id='P1S0' THEN 'nan'::DOUBLE ELSE m3 END AS m3, m4, m5 FROM mx"""),
    # last finite row per timestamp inside the window, with the duplicate flag
    "dd": (("sgq", "cs"), """SELECT s.caseid, track, t,
        arg_max(v, seq) FILTER (WHERE v IS NOT NULL AND isfinite(v)) AS v, count(*)>1 AS dup
        FROM sgq s JOIN cs USING (caseid) WHERE t BETWEEN w0 AND w1 GROUP BY 1,2,3
        HAVING count(*) FILTER (WHERE v IS NOT NULL AND isfinite(v))>0"""),
    # file-order first and last timestamp inside the window per primary track, common span, grid
    "sp": (("sg", "cs"), """SELECT caseid, w0, w1,
        CASE WHEN count(*)=3 THEN max(f) END AS s0, CASE WHEN count(*)=3 THEN min(l) END AS s1 FROM (
          SELECT s.caseid, track, w0, w1, arg_min(t, seq) AS f, arg_max(t, seq) AS l
          FROM sg s JOIN cs USING (caseid) WHERE t BETWEEN w0 AND w1 AND track IN ('SIG','RATE_A','RATE_B') GROUP BY ALL)
        GROUP BY 1,2,3"""),
    "gr": (("sp",), """SELECT caseid, w0, i, w0+i*21600.0 AS g, i-lo AS k, hi-lo+1 AS n FROM (
        SELECT caseid, w0, ceil((greatest(w0,s0)-w0)/21600.0-1e-12)::BIGINT AS lo,
          floor((least(w1,s1)-w0)/21600.0+1e-12)::BIGINT AS hi FROM sp WHERE s1>=s0), unnest(generate_series(lo,hi)) AS u(i)"""),
}
for _rule, _cut in RULES.items():
    if _cut is None:
        CTES[f"ok_{_rule}"] = (("dd",), "SELECT caseid, t, v, dup FROM dd WHERE track='SIG' AND v BETWEEN 0 AND 100")
    else:
        CTES[f"ok_{_rule}"] = (("dd",), f"""SELECT a.caseid, a.t, a.v, a.dup OR q.dup AS dup FROM dd a JOIN dd q
            ON a.caseid=q.caseid AND a.t=q.t AND q.track='QLT' WHERE a.track='SIG' AND a.v BETWEEN 0 AND 100 AND q.v>={_cut}""")
    CTES[f"as_{_rule}"] = (("gr", f"ok_{_rule}"), f"""SELECT gr.caseid, gr.k, gr.n, gr.g, o.t AS ot, o.v, o.dup, gr.g-o.t AS age
        FROM gr ASOF LEFT JOIN ok_{_rule} o ON gr.caseid=o.caseid AND gr.g>=o.t""")
for _track in (RATE_A, RATE_B, EXP):
    CTES[f"as_{_track}"] = (("gr", "dd"), f"""SELECT gr.caseid, gr.k, gr.n, gr.g, o.t AS ot, o.v, o.dup, gr.g-o.t AS age
        FROM gr ASOF LEFT JOIN (SELECT * FROM dd WHERE track='{_track}') o ON gr.caseid=o.caseid AND gr.g>=o.t""")


def sql(body: str, *needs: str, **more: str) -> str:
    """``body`` with the CTEs it needs (``more``: extra CTEs, in order, after them)."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for dep in CTES[name][0]:
                visit(dep)
            done.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done] + [f"{n} AS MATERIALIZED ({b})" for n, b in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def tree(name: str, src: str, key: str, number: str, line: str, levels: int = 3) -> dict[str, str]:
    """CTEs of the hash tree of ``src`` by ``key``: the last one, ``name``, has (k, ids, sha256).

    Enough for numbers below 1024 ** levels; a lone block 0 is not hashed again.
    """
    out = {f"{name}_0": f"SELECT {key} AS k, {number}//1024 AS p, sha256(string_agg({line}, chr(10) ORDER BY {number})||chr(10)) AS h, count(*) AS c FROM {src} GROUP BY ALL"}
    for i in range(1, levels):
        out[f"{name}_{i}"] = (f"SELECT k, x.p//1024 AS p, CASE WHEN count(*)=1 AND max(x.p)=0 THEN max(h) ELSE sha256(string_agg(h, chr(10) ORDER BY x.p)||chr(10)) END AS h, "
                              f"sum(c) AS c FROM {name}_{i - 1} x GROUP BY k, x.p//1024")
    return {**out, name: f"SELECT k, c::BIGINT AS ids, h AS sha256 FROM {name}_{levels - 1}"}
