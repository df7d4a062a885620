"""Line dedup by site-relative frequency.

A line is boilerplate on its host if the share of the host's pages that contain it
exceeds ``max_share`` and at least ``min_pages`` pages do.  Lines are compared by a
pair of 64-bit hashes, so only hashes are counted; a page counts once per line.

A host has at most (mean distinct lines per page) / ``max_share`` boilerplate
lines, so its set fits one array.  Pages meet that array by a broadcast of checked
size, beyond it by a join on host and salt; no text is grouped.

Cases: null hosts are one host of their own; a null text stays null and has no
lines; lines without a word are never counted and never dropped; a page whose lines
all go keeps its row with an empty text; repeated rows with one id count as that
many pages; an empty table gives an empty table; other columns pass unchanged, and
input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import attach, table

MAX_SHARE = 0.05
#: One page repeats nothing; from two on the share alone decides.
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("2"), line).alias("b"))


def boilerplate(df: DataFrame, host: str, text: str, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_key, _boiler): the line keys of each host that exceed the share; only hosts with such lines."""
    pages = df.select(F.col(host).alias("_host"), F.array_distinct(
        F.transform(F.filter(_lines(F.col(text)), _has_word), _key)).alias("_keys"))
    # the page itself is counted as a null line: one aggregation gives the line counts and the host totals
    counted = (pages.select("_host", F.explode(F.concat(F.coalesce("_keys", F.array()), F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")))).alias("_line"))
               .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= min_pages) | F.col("_line").isNull()))
    totals = counted.filter(F.col("_line").isNull()).select("_host", F.col("_n").alias("_pages"))
    lines = counted.filter(F.col("_line").isNotNull())
    over = lines.join(totals, lines["_host"].eqNullSafe(totals["_host"])).select(lines["_host"], "_line", "_n", "_pages").filter(
        F.col("_n") > F.lit(max_share) * F.col("_pages"))
    return over.groupBy(F.col("_host").alias("_key")).agg(F.collect_list("_line").alias("_boiler"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows of ``df`` with ``text`` without boilerplate lines, and ``n_lines`` and ``n_dropped`` (long)."""
    salt = F.xxhash64(*[c for c, kind in df.dtypes if kind in ("bigint", "int", "string") and c != host])
    joined = attach(df, boilerplate(df, host, text, max_share, min_pages), host, salt)
    kept = F.filter(_lines(F.col(text)), lambda x: ~(_has_word(x) & F.coalesce(F.array_contains("_boiler", _key(x)), F.lit(False))))
    joined = joined.withColumns({"n_lines": F.coalesce(F.size(_lines(F.col(text))), F.lit(0)).cast("bigint"), "_kept": F.when(F.col("_boiler").isNotNull(), kept)})
    return joined.withColumns({
        "n_dropped": F.when(F.col("_kept").isNotNull(), F.col("n_lines") - F.size("_kept")).otherwise(F.lit(0)).cast("bigint"),
        text: F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text))}).drop("_boiler", "_kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the source is the site."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(rows).select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, source, unnest(lines) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT c.source, list(line) AS boiler FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE n >= {MIN_PAGES} AND n > {MAX_SHARE} * pages GROUP BY c.source),
k AS (SELECT d.doc_id, d.source, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boiler, []), x)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k"""
