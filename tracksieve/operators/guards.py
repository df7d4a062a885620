"""Guards: universes, completeness, quarantine, validation, authorisation.

Nothing is dropped silently: every check returns its findings as rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import normalize_key
from tracksieve.operators.ordered import SEG, SPAN, previous_row, ranked, segment_of, segmented


def expected_universe(spark: SparkSession, start: int, end: int, key: str = "caseid") -> DataFrame:
    return spark.range(start, end + 1).withColumnRenamed("id", key)


def completeness(rows: DataFrame, universe: DataFrame, key: str = "caseid") -> DataFrame:
    """(key, problem, occurrences) for every missing, extra or duplicated key."""
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = universe.select(key, F.lit(True).alias("_want")).join(seen, key, "full_outer")
    problem = (F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_n") > 1, "duplicate"))
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        key, "problem", F.coalesce("_n", F.lit(0)).alias("occurrences"))


def key_alignment(left: DataFrame, right: DataFrame, key: str = "caseid") -> DataFrame:
    """Keys by side: both / left_only / right_only."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("keys"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def classify_rows(
    rows: DataFrame, *, raw_key: str, order: str, start: int, end: int, required: Sequence[str] = (), unique: Sequence[str] = (), span: int = SPAN,
) -> DataFrame:
    """Every source row with its integer ``caseid``, ``failure_type`` (null if clean) and ``passes``.

    Invalid and out-of-range keys and missing fields are held back; a repeat of
    an earlier row passes and is flagged.  Rows are compared in source order on
    segments, so a row repeated any number of times stays distributed.
    """
    r = rows.withColumn("caseid", normalize_key(raw_key))
    for c in required:
        r = r.withColumn(c, F.trim(F.coalesce(F.col(c), F.lit(""))))
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.col(c) == "")
    held = (F.when(F.col("caseid").isNull(), "invalid_caseid")
            .when((F.col("caseid") < start) | (F.col("caseid") > end), "out_of_range_caseid")
            .when(blank, "track_parse_error"))
    r = r.withColumn("_held", held)
    if not unique:
        return r.select("*", F.col("_held").alias("failure_type"), F.col("_held").isNull().alias("passes")).drop("_held")
    groups = ["caseid", *unique, "_clean"]
    s = previous_row(segmented(r.withColumn("_clean", F.col("_held").isNull()), order, span), groups, order, [order], "_before")
    # Held rows may have a null key and never join a carry; they need none.
    kind = F.coalesce(F.col("_held"), F.when(F.col("_before").isNotNull(), F.lit("duplicate_track_row")))
    return s.select(*rows.columns, "caseid", kind.alias("failure_type"), F.col("_clean").alias("passes"))


def failure_digest(failures: DataFrame) -> DataFrame:
    """Per case over (caseid, source_rank, seq, failure_type, message): count, first type and message, type set.

    The set is bounded by the number of types; ``failure_messages`` has all messages.
    """
    first = F.min(F.struct("source_rank", "seq", "failure_type", "message"))
    return failures.groupBy("caseid").agg(
        F.count(F.lit(1)).alias("failures"), first.alias("_f"), F.array_sort(F.collect_set("failure_type")).alias("failure_types"),
    ).select("caseid", "failures", F.col("_f.failure_type").alias("first_type"), F.col("_f.message").alias("first_message"), "failure_types")


def failure_messages(failures: DataFrame, chunk: int = 1000) -> DataFrame:
    """(caseid, chunk, n, messages): all messages of a case in the order of source and row, in chunks of bounded size."""
    rows = failures.withColumn(SEG, F.col("source_rank").cast("bigint") * F.lit(1 << 40) + segment_of("seq", SPAN))
    placed = ranked(rows, ["caseid"], ["source_rank", "seq", "failure_type", "message"], "_r")
    return placed.groupBy("caseid", F.floor((F.col("_r") - 1) / chunk).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_r", "message"))).alias("_m")).select(
        "caseid", "chunk", "n", F.transform("_m", lambda m: m["message"]).alias("messages"))


def violations(rows: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key..., rule) for every rule a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def preconditions(rows: DataFrame, checks: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """(check, expected, observed, ok) from one aggregate; values compared as text."""
    cells = [F.struct(F.lit(n).alias("check"), F.lit(str(want)).alias("expected"), agg.cast("string").alias("observed"))
             for n, (agg, want) in checks.items()]
    one = rows.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    return one.withColumn("ok", F.col("expected").eqNullSafe(F.col("observed")))


def lineage_mismatches(a: DataFrame, b: DataFrame, key: str, text: str, number: str) -> DataFrame:
    """Keys whose text or number differs between two sources, with the kind of mismatch."""
    j = a.select(key, F.col(text).alias("_ta"), F.col(number).alias("_na")).join(
        b.select(key, F.col(text).alias("_tb"), F.col(number).alias("_nb")), key)
    kind = (F.when(~F.col("_ta").eqNullSafe(F.col("_tb")) & ~F.col("_na").eqNullSafe(F.col("_nb")), "text_and_number")
            .when(~F.col("_ta").eqNullSafe(F.col("_tb")), "text").when(~F.col("_na").eqNullSafe(F.col("_nb")), "number"))
    return j.select(key, kind.alias("mismatch")).where(F.col("mismatch").isNotNull())


# Ordered refusal reasons of a read request.
READ_REASONS = ("split_not_permitted", "track_outside_allowlist", "case_not_in_cohort", "unlisted_source",
                "download_incomplete", "checksum_unverified", "manifest_disagreement")


def authorise_reads(
    requests: DataFrame, splits: DataFrame, cohort: DataFrame, downloads: DataFrame, checksums: DataFrame,
    *, split: str, tracks: Sequence[str],
) -> DataFrame:
    """(caseid, track, allowed, reason): the first refusal in order, decided before any file is opened.

    ``downloads`` (caseid, track, status, bytes, sha) and ``checksums``
    (caseid, track, verified, bytes, sha) are unique per (caseid, track).
    """
    key = ["caseid", "track"]
    j = (
        requests.join(splits.select("caseid", F.col("split").alias("_s")), "caseid", "left")
        .join(cohort.select("caseid", F.lit(True).alias("_in")), "caseid", "left")
        .join(downloads.select(*key, F.col("status").alias("_st"), F.struct("bytes", "sha").alias("_d")), key, "left")
        .join(checksums.select(*key, F.col("verified").alias("_v"), F.struct("bytes", "sha").alias("_k")), key, "left"))
    fails = (
        ~F.col("_s").eqNullSafe(F.lit(split)), ~F.col("track").isin(*tracks), F.col("_in").isNull(),
        F.col("_d").isNull() | F.col("_k").isNull(), F.col("_st") != "complete", ~F.col("_v"), ~F.col("_d").eqNullSafe(F.col("_k")))
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in zip(fails, READ_REASONS)])
    return j.select(*key, reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("allowed")).alias("reason"))


# Which operations may see which splits.
TRAIN_ONLY = ("feature_selection", "scaler_fit", "imputer_fit", "normalization_fit", "pk_calibration_fit")
TRAIN_VALIDATION = ("early_stopping", "hyperparameter_selection")
SEALED_SUMMARIES = ("test_summary", "bis_distribution", "target_summary")
SPLITS = ("train", "validation", "test")


def split_policy(requests: DataFrame) -> DataFrame:
    """Verdict on (operation, splits array, authorised): allowed, or the first refusal."""
    op, s = F.col("operation"), F.col("splits")
    test = F.array_contains(s, "test")
    known = F.array(*[F.lit(x) for x in SPLITS])
    reason = (
        F.when(F.size(F.array_except(s, known)) > 0, "unknown_split")
        .when(op.isin(*SEALED_SUMMARIES) & test, "sealed_summary_prohibited")
        .when(op.isin(*TRAIN_ONLY) & (F.size(F.array_except(s, F.array(F.lit("train")))) > 0), "train_only")
        .when(op.isin(*TRAIN_VALIDATION) & test, "validation_but_not_test")
        .when(test & ~F.col("authorised"), "test_not_authorised"))
    return requests.select("*", reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("allowed")).alias("reason"))


def overlapping_splits(assignments: DataFrame, key: str = "caseid") -> DataFrame:
    """Keys assigned to more than one split (an empty result is the pass); no self-join."""
    return assignments.groupBy(key).agg(
        F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)  # at most one entry per split


def subject_mapping_conflicts(rows: DataFrame) -> DataFrame:
    """Cases that name more than one subject."""
    return rows.groupBy("caseid").agg(F.min("subjectid").alias("_a"), F.max("subjectid").alias("_b")).where(
        F.col("_a") != F.col("_b")).select("caseid")


def paired_accounting(rows: DataFrame, conditions: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(check, observed): duplicates, unknown conditions, non-finite metrics, incomplete cases, mapping conflicts."""
    from tracksieve.functions.columns import is_finite

    bad = F.lit(False)
    for m in metrics:
        bad = bad | ~is_finite(m)
    known = F.col("condition_id").isin(*conditions)
    pairs = rows.groupBy("caseid", "condition_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"), F.min("subjectid").alias("_s0"), F.max("subjectid").alias("_s1"))
    cases = pairs.groupBy("caseid").agg(
        F.count_if(known).alias("_k"), F.count_if(~known).alias("_u"), F.sum(F.col("_n") - 1).alias("_d"), F.sum("_bad").alias("_bad"),
        F.sum("_n").alias("_rows"), (F.min("_s0") != F.max("_s1")).alias("_c"))
    cells = {
        "rows": F.sum("_rows"), "cases": F.count(F.lit(1)), "duplicate_pairs": F.sum("_d"), "unknown_conditions": F.sum("_u"),
        "nonfinite_rows": F.sum("_bad"), "incomplete_cases": F.count_if(F.col("_k") != len(conditions)), "mapping_conflicts": F.count_if("_c")}
    one = cases.agg(F.array(*[F.struct(F.lit(n).alias("check"), c.cast("bigint").alias("observed")) for n, c in cells.items()]).alias("_c"))
    return one.select(F.explode("_c").alias("_c")).select("_c.*")


def registry_problems(registry: DataFrame, statuses: Sequence[str] = ("validated", "pending", "unknown")) -> DataFrame:
    """(tname, problem): a name in two concepts, both active and pending, or with an unknown unit status."""
    per = registry.groupBy("tname").agg(
        F.count_distinct("concept").alias("_n"), F.max((F.col("state") == "active").cast("int")).alias("_a"),
        F.max((F.col("state") == "pending").cast("int")).alias("_p"), F.max((~F.col("unit_status").isin(*statuses)).cast("int")).alias("_u"))
    found = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "several_concepts"), F.when((F.col("_a") == 1) & (F.col("_p") == 1), "active_and_pending"),
        F.when(F.col("_u") == 1, "unknown_unit_status")))
    return per.select("tname", F.explode(found).alias("problem"))


def units_approved(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, approved): every requested concept exists with validated units only."""
    per = registry.groupBy("concept").agg(F.bool_and(F.col("unit_status") == "validated").alias("_ok"))
    return requests.join(per, "concept", "left").groupBy("request").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("approved"))


def aggregate_problems(conditions: DataFrame, contrasts: DataFrame, expected: DataFrame) -> DataFrame:
    """Integrity of a result: ordered quantiles, ordered intervals, adjusted p >= p, full (metric, contrast) cover."""
    a = violations(conditions, ["metric", "condition_id"], {
        "min_le_q1": F.col("minimum") <= F.col("q1"), "q1_le_median": F.col("q1") <= F.col("median"),
        "median_le_q3": F.col("median") <= F.col("q3"), "q3_le_max": F.col("q3") <= F.col("maximum")}).withColumnRenamed("condition_id", "item")
    b = violations(contrasts, ["metric", "contrast"], {
        "ci_ordered": F.col("ci_low") <= F.col("ci_high"), "p_within_0_1": F.col("p").between(0, 1),
        "adjusted_ge_raw": F.col("adjusted_p") >= F.col("p")}).withColumnRenamed("contrast", "item")
    c = expected.join(contrasts.select("metric", "contrast"), ["metric", "contrast"], "left_anti").select(
        "metric", F.col("contrast").alias("item"), F.lit("missing_contrast").alias("rule"))
    return a.unionByName(b).unionByName(c)


def disclosure_findings(df: DataFrame, forbidden: Sequence[str], path_pattern: str = r"^(/|[A-Za-z]:\\|\\\\|~/|\.\./)") -> DataFrame:
    """(column, finding, rows): forbidden column names, and path-like text in any string column."""
    text = [c for c, t in df.dtypes if t == "string"]
    named = [c for c in df.columns if c.lower() in {f.lower() for f in forbidden}]
    cells = [F.struct(F.lit(c).alias("column"), F.lit("forbidden_name").alias("finding"), F.count(F.lit(1)).alias("rows")) for c in named]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("path_like_text").alias("finding"), F.count_if(F.col(c).rlike(path_pattern)).alias("rows")) for c in text]
    if not cells:
        cells = [F.struct(F.lit("").alias("column"), F.lit("none").alias("finding"), F.lit(0).cast("bigint").alias("rows"))]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*").where(F.col("rows") > 0)
