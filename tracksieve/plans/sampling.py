"""Sampling queries on the linkage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.operators import checksums, sampling as sm
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r
from tracksieve.plans.subjects import tree_sql


def rows(spark: SparkSession, d: str) -> DataFrame:
    l = fx.linkage_source(spark, d)
    return l.select("caseid", "subjectid", "age", F.col("weight").alias("bytes"), F.concat_ws("|", "sex", "asa").alias("stratum"))


CTE = dict(rw="SELECT caseid, subjectid, age, weight AS bytes, sex||'|'||asa AS stratum FROM lk")


def sql(body: str, **more: str) -> str:
    return fx.sql(body, "lk", **CTE, **more)


STRAT = """SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('7'||chr(0)||stratum||chr(0)||caseid), caseid)<=2"""


def stratified(spark: SparkSession, d: str) -> DataFrame:
    return _r(sm.stratified_sample(rows(spark, d), "stratum", 7, 2))


def topk(spark: SparkSession, d: str) -> DataFrame:
    return sm.hash_top(rows(spark, d).select("caseid", "subjectid"), 20260719, 25)


def extrapolation(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    return _r(sm.extrapolate(sm.stratified_sample(r, "stratum", 7, 2), r, "stratum", ["bytes"]))


EXTRA_SQL = sql("""SELECT stratum, population, sampled, round(mean_bytes,6)+0.0 AS mean_bytes, round(mean_bytes*population,6)+0.0 AS estimated_bytes FROM ex
  UNION ALL SELECT NULL, sum(population)::BIGINT, sum(sampled)::BIGINT, NULL, ceil(sum(mean_bytes*population)*1.2+52428800)::DOUBLE FROM ex""", s2=STRAT,
                ex="SELECT stratum, count(*)::BIGINT AS population, (SELECT count(*) FROM s2 WHERE s2.stratum=rw.stratum)::BIGINT AS sampled, (SELECT avg(bytes) FROM s2 WHERE s2.stratum=rw.stratum) AS mean_bytes FROM rw GROUP BY 1")


def spread(spark: SparkSession, d: str) -> DataFrame:
    return _r(sm.spread_pick(rows(spark, d), ["age", "bytes"], "subjectid"))


SPREAD_SQL = sql("""SELECT position, subjectid, round(age,6)+0.0 AS age, bytes, caseid FROM (SELECT *, CASE WHEN r=1 THEN 'first' WHEN r=(n+1)//2 THEN 'middle' WHEN r=n THEN 'last' END AS position FROM (
   SELECT *, row_number() OVER (ORDER BY age, bytes, caseid) AS r, count(*) OVER () AS n FROM (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY subjectid ORDER BY age, bytes, caseid)=1))) WHERE position IS NOT NULL""")


def draws(spark: SparkSession, d: str) -> DataFrame:
    return sm.draws_with_replacement(spark, rows(spark, d), "caseid", 5000, 42)


DRAW_CTE = dict(
    rk="SELECT caseid, row_number() OVER (ORDER BY sha256('42'||chr(0)||caseid), caseid) AS r, count(*) OVER () AS n FROM rw",
    dr="SELECT draw, caseid FROM (SELECT i AS draw, ('0x'||substr(sha256('42|'||i),1,15))::BIGINT AS h FROM range(5000) t(i)) JOIN rk ON rk.r=h%rk.n+1")


def draw_order_hash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of the drawn sequence, in draw order."""
    drawn = draws(spark, d).select("draw", F.col("caseid").cast("string").alias("line"))
    return checksums.tree_checksum(drawn, "draw", text="line")


QUERIES = {
    "stratified_sample": Query(stratified, sql("SELECT * REPLACE (round(age,6)+0.0 AS age) FROM s2", s2=STRAT)),
    "hash_topk": Query(topk, sql("SELECT caseid, subjectid, sha256('20260719'||chr(0)||caseid) AS rank_hash FROM rw ORDER BY 3, 1 LIMIT 25")),
    "stratum_extrapolation": Query(extrapolation, EXTRA_SQL),
    "spread_pick": Query(spread, SPREAD_SQL),
    "draws_with_replacement": Query(draws, sql("SELECT draw, caseid FROM dr", **DRAW_CTE)),
    "draw_order_hash": Query(draw_order_hash, tree_sql(sql("x", **DRAW_CTE), "SELECT ids, sha256 FROM tr", "dr", "1", "draw", "caseid::VARCHAR")),
}
