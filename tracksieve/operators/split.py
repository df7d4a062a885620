"""Deterministic stratified split of subjects, its balance and its guard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksieve.functions.columns import AGE_ORDER, COUNT_BAND_ORDER, SEX_ORDER, nul_hash
from tracksieve.functions.quantiles import exact_quantiles
from tracksieve.operators.checksums import tree_checksum
from tracksieve.operators.ordered import SEG, hash_segment, ranked, spread_join
from tracksieve.session import cut_lineage

# Split names and shares of the three-way targets, allocation seed.
PROPORTIONS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
SEED = 20260720


def largest_remainder(totals: DataFrame, shares: Sequence[tuple[str, float]] = PROPORTIONS) -> DataFrame:
    """(unit, split, ideal, target): whole-number targets; spare units go to the largest remainders.

    ``totals`` is (unit, total), a few rows.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("split"), F.lit(s).alias("share")) for i, (n, s) in enumerate(shares)]))
    p = totals.select("unit", "total", parts.alias("_p")).select("unit", "total", "_p.*").withColumn("ideal", F.col("total") * F.col("share"))
    p = p.withColumn("_floor", F.floor("ideal"))
    unit = Window.partitionBy("unit")
    rank = F.row_number().over(unit.orderBy((F.col("ideal") - F.col("_floor")).desc(), "o"))
    spare = F.col("total") - F.sum("_floor").over(unit)
    return p.select("unit", "split", "ideal", (F.col("_floor") + (rank <= spare).cast("bigint")).alias("target"))


def canonical_strata(spark: SparkSession) -> DataFrame:
    """(ord, stratum): sex x age band x count band in canonical order, 24 literal rows."""
    keys = [f"{s}|{a}|{b}" for s in SEX_ORDER for a in AGE_ORDER for b in COUNT_BAND_ORDER]
    return spark.createDataFrame([(i + 1, k) for i, k in enumerate(keys)], "ord int, stratum string")


def stratum_counts(subjects: DataFrame) -> DataFrame:
    n = subjects.groupBy("stratum").agg(F.count(F.lit(1)).alias("subjects"))
    return canonical_strata(subjects.sparkSession).join(n, "stratum", "left").fillna(0, ["subjects"])


def hamilton_quotas(counts: DataFrame, divisor: int = 5, target: int | None = None) -> DataFrame:
    """Test quota per stratum: floor(n/divisor), spare slots by largest remainder, then canonical order.

    ``target`` defaults to floor(total/divisor).  Works on the fixed table of strata.
    """
    whole = Window.partitionBy(F.lit(0))  # 24 strata
    n = F.col("subjects")
    q = counts.withColumn("floor_quota", F.floor(n / divisor)).withColumn("remainder", n % divisor)
    want = F.lit(target) if target is not None else F.floor(F.sum("subjects").over(whole) / divisor)
    slots = want - F.sum("floor_quota").over(whole)
    rank = F.row_number().over(whole.orderBy(F.col("remainder").desc(), "ord"))
    return q.withColumn("quota", F.col("floor_quota") + (rank <= slots).cast("bigint")).withColumn("train_count", n - F.col("quota"))


def allocate(subjects: DataFrame, quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """Assign each subject by the rank of its hash in the stratum: rank <= quota goes to test.

    Hash prefixes cut a stratum into equal segments, so 24 strata do not mean 24 tasks.
    """
    h = subjects.select("subjectid", "stratum", nul_hash(F.lit(seed), "stratum", "subjectid").alias("rank_hash"))
    r = ranked(h.withColumn(SEG, hash_segment("rank_hash")), ["stratum"], ["rank_hash", "subjectid"], "within_stratum_rank").drop(SEG)
    small = F.broadcast(quotas.select("stratum", "quota"))  # 24 rows
    return r.join(small, "stratum").withColumn(
        "assigned_split", F.when(F.col("within_stratum_rank") <= F.col("quota"), "test").otherwise("train"))


def case_split(cases: DataFrame, allocation: DataFrame) -> DataFrame:
    """Cases inherit their subject's split; an unknown subject leaves it null."""
    return spread_join(cases.select("caseid", "subjectid"), allocation.select("subjectid", "assigned_split"), ["subjectid"], "caseid", "left")


def balance_continuous(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Train/test moments, quartiles and standardised mean difference per variable."""
    long = rows.select(F.col("assigned_split").alias("s"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("_v")).select("s", "_v.*")
    m = long.groupBy("variable").agg(*[c for g in ("train", "test") for x in (F.when(F.col("s") == g, F.col("x")),) for c in (
        F.count(x).alias(f"{g}_n"), F.avg(x).alias(f"{g}_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{g}_sd"))])
    q = exact_quantiles(long, ["variable", "s"], "x", {"q1": .25, "median": .5, "q3": .75}, method="linear").groupBy("variable").agg(*[
        F.max(F.when(F.col("s") == g, F.col(k))).alias(f"{g}_{k}") for g in ("train", "test") for k in ("q1", "median", "q3")])
    pooled = F.sqrt((F.col("train_sd") * F.col("train_sd") + F.col("test_sd") * F.col("test_sd")) / 2)
    gap = F.col("train_mean") - F.col("test_mean")
    smd = F.when(pooled > 0, gap / pooled).when(gap == 0, 0.0)
    verdict = F.when(F.abs("smd") <= 0.10, "acceptable").when(F.abs("smd") <= 0.20, "warning").otherwise("hard_fail")
    return m.join(q, "variable").withColumn("smd", smd).withColumn("interpretation", verdict)


def balance_categorical(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Train/test counts, proportions and their difference per variable and level."""
    long = rows.select(F.col("assigned_split").alias("s"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])).alias("_v")).select("s", "_v.*")
    n = long.groupBy("variable", "level").agg(*[F.count_if(F.col("s") == g).alias(f"{g}_count") for g in ("train", "test")])
    whole = n.groupBy("variable").agg(*[F.sum(f"{g}_count").alias(f"{g}_n") for g in ("train", "test")])
    j = n.join(F.broadcast(whole), "variable")  # one row per variable
    p = [F.col(f"{g}_count") / F.col(f"{g}_n") for g in ("train", "test")]
    return j.select("*", p[0].alias("train_proportion"), p[1].alias("test_proportion"), (p[0] - p[1]).alias("difference")).withColumn(
        "interpretation", F.when(F.abs("difference") <= 0.05, "acceptable").otherwise("warning"))


def balance_summary(continuous: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Largest absolute SMD, warning counts and the publication gate."""
    rows = continuous.select(F.lit("continuous").alias("k"), F.abs("smd").alias("a"), "interpretation").unionByName(
        primary.select(F.lit("primary").alias("k"), F.lit(None).cast("double").alias("a"), "interpretation")).unionByName(
        secondary.select(F.lit("secondary").alias("k"), F.lit(None).cast("double").alias("a"), "interpretation"))

    def warned(kind: str, what: str = "warning") -> Column:
        return F.count_if((F.col("k") == kind) & (F.col("interpretation") == what))

    return rows.agg(
        F.max("a").alias("maximum_absolute_smd"), warned("continuous").alias("continuous_warnings"), warned("continuous", "hard_fail").alias("continuous_hard_failures"),
        warned("primary").alias("primary_warnings"), warned("secondary").alias("secondary_warnings")).withColumn(
        "gate_passed", F.col("maximum_absolute_smd") <= 0.20)


def split_guard(case_rows: DataFrame, subject_rows: DataFrame, seal: Mapping[str, str] | None = None) -> DataFrame:
    """(check, observed): subjects or cases in two splits, cases without parent, cases against their parent's split,
    and (with ``seal``: split -> checksum) splits whose id checksum differs from the sealed one."""
    def twice(df: DataFrame, key: str, name: str) -> DataFrame:
        per = df.groupBy(key).agg(F.min("assigned_split").alias("a"), F.max("assigned_split").alias("b"))
        return per.agg(F.count_if(F.col("a") != F.col("b")).alias("observed")).select(F.lit(name).alias("check"), "observed")

    parents = subject_rows.groupBy("subjectid").agg(F.min("assigned_split").alias("_p"))
    j = spread_join(case_rows, parents, ["subjectid"], "caseid", "left")
    out = twice(subject_rows, "subjectid", "subjects_in_two_splits").unionByName(twice(case_rows, "caseid", "cases_in_two_splits"))
    per_case = j.agg(F.count_if(F.col("_p").isNull()).alias("a"), F.count_if(F.col("_p") != F.col("assigned_split")).alias("b"))
    pair = F.array(F.struct(F.lit("cases_without_parent").alias("check"), F.col("a").alias("observed")),
                   F.struct(F.lit("cases_against_parent").alias("check"), F.col("b").alias("observed")))
    out = out.unionByName(per_case.select(F.explode(pair).alias("_c")).select("_c.*"))
    if seal is not None:
        now = tree_checksum(case_rows, "caseid", keys=["assigned_split"])
        want = F.lit(None).cast("string")
        for name, value in seal.items():
            want = F.when(F.col("assigned_split") == name, value).otherwise(want)
        out = out.unionByName(now.agg(F.count_if(~want.eqNullSafe(F.col("sha256"))).alias("observed")).select(F.lit("seal_mismatches").alias("check"), "observed"))
    return out


def _nearest_targets(total: int, shares: Sequence[tuple[str, float]]) -> list[int]:
    ideal = [total * s for _, s in shares]
    base = [int(x) for x in ideal]
    for i in sorted(range(len(ideal)), key=lambda i: (base[i] - ideal[i], i))[: total - sum(base)]:
        base[i] += 1
    return base


def _fills(need: Sequence[int], extras: Mapping[int, int]) -> bool:
    """Whether the needs are filled exactly by giving each extra, the largest first, to the part that lacks most."""
    left = list(need)
    for extra in sorted(extras, reverse=True):
        n = extras[extra]
        while n > 0:
            left.sort()
            rounds = min(n // 3, left[0] // extra)
            if rounds > 0 and left[-1] - left[0] <= extra:  # all lack about the same: whole rounds at once
                left = [x - extra * rounds for x in left]
                n -= 3 * rounds
                continue
            # The part that lacks most takes extras until it no longer lacks more than the next one, at least one.
            take = max(1, min(n, (left[-1] - left[-2]) // extra))
            if left[-1] < extra * take:
                return False
            left[-1] -= extra * take
            n -= take
    return not any(left)


def feasibility(cluster_sizes: DataFrame, shares: Sequence[tuple[str, float]] = PROPORTIONS) -> DataFrame:
    """Can nearest case and subject targets be met together, from the histogram of sizes alone?

    (cases, subjects, exact_case_targets, exact_joint, minimum_deviation, largest).  Input is one
    row per distinct size: fewer than the root of twice the number of cases.  A cluster brings
    its size less one as extra cases.  If filling the parts greedily meets every need exactly,
    the deviation is 0, which nothing beats.  Otherwise the reachable pairs (extras of the first
    and of the second part) grow as rows of a table, size by size, and the best one is taken.
    """
    spark = cluster_sizes.sparkSession
    found = {int(r[0]): int(r[1]) for r in cluster_sizes.groupBy("cluster_size").agg(F.sum("subjects")).collect()}
    cases, subjects = sum(s * n for s, n in found.items()), sum(found.values())
    case_targets, subject_targets = _nearest_targets(cases, shares), _nearest_targets(subjects, shares)
    alone = found.get(1, 0)
    by_case = cases - alone <= max(case_targets) and alone >= cases - max(case_targets)
    need = [c - s for c, s in zip(case_targets, subject_targets)]
    extras = {s - 1: n for s, n in found.items() if s > 1}
    best = 0 if min(need) >= 0 and _fills(need, extras) else None
    if best is None:
        whole = sum(e * n for e, n in extras.items())
        reached = spark.range(1).select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
        for e, n in sorted(extras.items()):
            first = reached.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
            both = first.select((F.col("a") + F.col("i") * e).alias("a"), "b", F.explode(F.sequence(F.lit(0), F.lit(n) - F.col("i"))).alias("j"))
            reached = cut_lineage(both.select("a", (F.col("b") + F.col("j") * e).alias("b")).distinct())
        off = F.abs(F.col("a") - need[0]) + F.abs(F.col("b") - need[1]) + F.abs(F.lit(whole) - F.col("a") - F.col("b") - need[2])
        best = reached.agg(F.min(off)).first()[0]
    return spark.createDataFrame(
        [(cases, subjects, by_case, best == 0, best, max(found))],
        "cases bigint, subjects bigint, exact_case_targets boolean, exact_joint boolean, minimum_deviation bigint, largest bigint")
