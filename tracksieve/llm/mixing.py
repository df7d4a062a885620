"""Mixing sources to target weights by whole copies and Pareto order sampling.

Sizes are words.  Sources share ``budget`` words by weight; no target exceeds
``most_copies`` times its source's size, and what is above goes to the others by
weight until none is above.  Within a source a document of weight w is expected
``min(most_copies, lambda * w)`` times, with lambda so that the expected words equal
the target.  The whole part of that number is taken for certain; the rest p is an
inclusion probability.  Documents are ranked by [u / (1 - u)] / [p / (1 - p)] with u
drawn from a hash of the id (Rosen's Pareto order sampling), and the first ones are
taken up to the size that is nearest to what the source still lacks.

Nothing orders a whole source in one task: ranks fall into ``RANK_CELLS`` cells whose
sizes are summed map-side, and only the cell with the cut is ordered.

Cases: null sources are one source, ordered last; a null or empty text has size 0
and costs nothing; rows with one id and source share a draw and are taken or left
together; an empty table gives an empty table; weights are rounded to sixteenths and
held within 1/16 and 16; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksieve.llm.workspace import WORD, attach, stored, table

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
RANK_CELLS = 4096
SHORT_WORDS = 50
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(ident: str | Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, budget_share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources in order.

    The order over all sources is made from ranges, not in one task; the shares are
    found in rounds, each of which returns one row of exact sums to the driver.
    """
    ranged = stored(sizes.repartitionByRange(32, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) + F.col("_before") - 1
    ordered = ranged.join(before, "_range").withColumn("_place", place)
    weighed = stored(ordered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int")).cast("bigint").alias("_weight")), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = total * budget_share, 0.0, (-1, -1)
    while True:
        above = F.lit(float(most)) * F.col("source_size") < F.lit(level) * F.col("_weight")
        held, free = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0))).first()
        if (held, free) == capped or not free:
            break
        capped, level = (held, free), (budget - most * held) / free
    full = F.lit(float(most)) * F.col("source_size")
    return weighed.select("source", "source_size", (F.least(full, F.lit(level) * F.col("_weight")) if free else full).alias("target"))


def _levels(classes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(_key, target, source_size, _lambda): expected copies are min(most, lambda * weight).  At most 256 classes a source."""
    c = attach(classes, targets.withColumnRenamed("source", "_key"), "source", F.lit(0), 1)
    down = Window.partitionBy("source").orderBy(F.col("_w").desc())
    above = F.coalesce(F.sum("_size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("_w") * F.col("_size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("_level", F.when(below > 0, (F.col("target") - most * above) / below))
    fits = F.col("_level") * F.col("_w") <= F.lit(most)
    return c.groupBy(F.col("source").alias("_key")).agg(
        F.first("target").alias("target"), F.first("source_size").alias("source_size"),
        F.coalesce(F.max_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_w"))), F.lit(most) / F.min("_w")).alias("_lambda"))


def mix(df: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", weight: Column | None = None,
        budget_share: float = 1.0, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Rows of ``df`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= size * copies)."""
    w = F.lit(1.0) if weight is None else weight
    level = F.greatest(F.lit(1), F.least(F.lit(256), F.round(w * 16))).cast("double") / 16
    sized = df.withColumn("size", word_count(F.col(text))).withColumn("_w", F.coalesce(level, F.lit(1.0)))
    narrow = stored(sized.select(F.col(ident).alias("_id"), F.col(source).alias("source"), "size", "_w"), "sizes")
    classes = stored(narrow.groupBy("source", "_w").agg(F.sum("size").alias("_size")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("_size").alias("source_size")), budget_share, most=most)
    levels = stored(_levels(classes, targets, most), "levels")

    def ranked(rows: DataFrame, key: str, by: Column) -> DataFrame:
        rows = attach(rows, levels, key, by)
        expected = F.least(F.lit(float(most)), F.col("_lambda") * F.col("_w"))
        rows = rows.withColumn("_sure", F.floor(expected)).withColumn("_p", expected - F.col("_sure"))
        u = draw(by, seed)
        # the cell scales the rank by a typical odds of the source, so cells hold like numbers of rows
        typical = F.col("_lambda") - F.floor("_lambda")
        typical = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), typical))
        rows = rows.withColumn("_rank", F.when(F.col("_p") > 0, (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))))
        scaled = F.col("_rank") * (typical / (1 - typical))
        return rows.withColumn("_cell", F.least(F.lit(RANK_CELLS - 1), F.floor(scaled / (1 + scaled) * RANK_CELLS)).cast("int"))

    parts = ranked(narrow, "source", F.col("_id"))
    cells = stored(parts.groupBy("source", "_cell").agg(F.sum("size").alias("_size"), F.sum(F.col("_sure") * F.col("size")).alias("_sure")), "cells")
    lacks = cells.groupBy(F.col("source").alias("_key")).agg(F.sum("_sure").alias("_whole"))
    lacks = lacks.join(levels, lacks["_key"].eqNullSafe(levels["_key"])).select(lacks["_key"], (F.col("target") - F.col("_whole")).alias("_lack"))
    ends = attach(cells.filter(F.col("_cell").isNotNull()), lacks, "source", F.lit(0), 1)
    ends = ends.withColumn("_end", F.sum("_size").over(Window.partitionBy("source").orderBy("_cell")))
    cut = ends.filter(F.col("_end") >= F.col("_lack")).groupBy(F.col("source").alias("_key")).agg(
        F.min("_cell").alias("_cut_cell"), F.min_by(F.col("_end") - F.col("_size"), "_cell").alias("_start"), F.first("_lack").alias("_lack"))
    cut = stored(cut, "cuts")
    near = attach(parts, cut, "source", F.xxhash64("_id"), how="inner").filter(F.col("_cell") == F.col("_cut_cell"))
    sums = near.withColumn("_sum", F.col("_start") + F.sum("size").over(Window.partitionBy("source").orderBy("_rank")))
    best = sums.groupBy(F.col("source").alias("_key")).agg(
        F.min(F.struct(F.abs(F.col("_sum") - F.col("_lack")).alias("off"), F.col("_rank").alias("rank"))).alias("best"), F.first("_start").alias("_start"), F.first("_lack").alias("_lack"))
    best = best.select("_key", F.when(F.col("best.off") < F.abs(F.col("_start") - F.col("_lack")), F.col("best.rank")).otherwise(F.lit(-1.0)).alias("_cut_rank"))
    edges = cut.join(best, cut["_key"].eqNullSafe(best["_key"])).select(cut["_key"], "_cut_cell", "_cut_rank")

    rows = attach(ranked(sized, source, F.col(ident)), edges, source, F.xxhash64(ident))
    more = F.col("_p") > 0
    more = more & (F.col("_cut_cell").isNull() | (F.col("_cell") < F.col("_cut_cell")) | ((F.col("_cell") == F.col("_cut_cell")) & (F.col("_rank") <= F.col("_cut_rank"))))
    copies = (F.col("_sure") + F.when(more, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop(
        "_w", "_lambda", "_sure", "_p", "_rank", "_cell", "_cut_cell", "_cut_rank")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row as often as its ``copies`` say."""
    return mixed.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def length_weight(text: str = "text") -> Column:
    """Production weight: documents under ``SHORT_WORDS`` words count half."""
    return F.when(word_count(F.col(text)) < SHORT_WORDS, F.lit(0.5)).otherwise(F.lit(1.0))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, weight=length_weight()).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
x AS (SELECT *, CASE WHEN size < {SHORT_WORDS} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
             (('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM d GROUP BY source),
o AS (SELECT *, CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS held,
             CAST(sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
v AS (SELECT min_by((total::DOUBLE - 3 * held) / free, held) AS level FROM o WHERE 3.0::DOUBLE * source_size >= (total::DOUBLE - 3 * held) / free * weight),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, level * weight) AS target FROM s, v),
c AS (SELECT t.source, w, sum(size) AS size, any_value(target) AS target FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source GROUP BY t.source, w),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
             sum(w * size) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM c),
l AS (SELECT source, coalesce(max_by((target - 3 * above) / below, w) FILTER (WHERE below > 0 AND (target - 3 * above) / below * w <= 3), 3 / min(w)) AS lam FROM b GROUP BY source),
e AS (SELECT doc_id, x.source, size, source_size, target, u, least(3.0::DOUBLE, lam * w) AS copies
      FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source JOIN l ON x.source IS NOT DISTINCT FROM l.source),
p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS sure, copies - floor(copies) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
             target - sum(sure * size) OVER (PARTITION BY source) AS lack FROM p),
g AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q) AS run FROM q WHERE q IS NOT NULL),
h AS (SELECT source, min_by(q, abs(run - lack)) AS cut, min(abs(run - lack)) AS off, any_value(lack) AS lack FROM g GROUP BY source)
SELECT doc_id, size, source_size, target, size * (sure + CASE WHEN q <= cut AND off < abs(h.lack) THEN 1 ELSE 0 END) AS taken, q.source,
       sure + CASE WHEN q <= cut AND off < abs(h.lack) THEN 1 ELSE 0 END AS copies
FROM q LEFT JOIN h ON q.source IS NOT DISTINCT FROM h.source"""
