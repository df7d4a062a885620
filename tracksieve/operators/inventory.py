"""Track inventory, eligibility manifest, task matrix, funnel, frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import adult_label, clean_number, clean_text, first_present, missing_label, number_class, valid_interval


def registry(spark: SparkSession, concepts: Mapping[str, Sequence[str]], pending: Mapping[str, Sequence[str]] | None = None,
             unit_status: Mapping[str, str] | None = None) -> DataFrame:
    """Alias registry (concept, tname, state, unit_status): a handful of literal rows."""
    units = unit_status or {}
    rows = [(c, n, state, units.get(c, "pending")) for state, table in (("active", concepts), ("pending", pending or {}))
            for c, names in table.items() for n in names]
    return spark.createDataFrame(rows, "concept string, tname string, state string, unit_status string")


def with_concept(tracks: DataFrame, reg: DataFrame) -> DataFrame:
    """Exact-name match to an active concept; other names drop out (see ``unregistered_names``)."""
    active = reg.where(F.col("state") == "active").select("tname", "concept")
    return tracks.withColumn("tname", F.trim("tname")).join(F.broadcast(active), "tname")  # registry: literal rows


def unregistered_names(tracks: DataFrame, reg: DataFrame) -> DataFrame:
    """Names outside the active registry with rows, cases and distinct ids."""
    active = reg.where(F.col("state") == "active").select("tname")
    rest = tracks.withColumn("tname", F.trim("tname")).join(F.broadcast(active), "tname", "left_anti")
    return name_counts(rest)


def name_counts(tracks: DataFrame) -> DataFrame:
    """Rows, distinct cases and distinct ids per name; duplicates collapse before the counts meet at a name."""
    unit = tracks.groupBy("tname", "caseid", "tid").agg(F.count(F.lit(1)).alias("_n"))
    cases = unit.groupBy("tname", "caseid").agg(F.sum("_n").alias("_n")).groupBy("tname").agg(
        F.sum("_n").alias("row_count"), F.count(F.lit(1)).alias("case_count"))
    ids = unit.select("tname", "tid").distinct().groupBy("tname").agg(F.count("tid").alias("tid_count"))
    return cases.join(ids, "tname")


def presence(universe: DataFrame, tracks: DataFrame, names: Mapping[str, str], any_of: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One boolean column per requested name and per any-of group, for every case of the universe."""
    t = tracks.where(F.col("tname").isin(*names.values()))
    seen = t.groupBy("caseid").agg(*[F.max((F.col("tname") == n)).alias(col) for col, n in names.items()])
    out = universe.join(seen, "caseid", "left").fillna(False, list(names))
    for group, members in (any_of or {}).items():
        flag = F.lit(False)
        for m in members:
            flag = flag | F.col(m)
        out = out.withColumn(group, flag)
    return out


def task_matrix(universe: DataFrame, tracks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Expected case x track rows with the number of distinct ids, the smallest one, and a status."""
    expected = universe.select("caseid", F.explode(F.array(*[F.lit(n) for n in names])).alias("tname"))
    ids = tracks.where(F.col("tname").isin(*names)).select("caseid", "tname", "tid").distinct().groupBy("caseid", "tname").agg(
        F.count(F.lit(1)).alias("ids"), F.min("tid").alias("tid"))
    n = F.coalesce("ids", F.lit(0))
    return expected.join(ids, ["caseid", "tname"], "left").select(
        "caseid", "tname", n.alias("ids"), F.when(n == 1, F.col("tid")).alias("tid"),
        F.when(n == 0, "absent").when(n == 1, "ok").otherwise("ambiguous").alias("status"))


def manifest_rows(tasks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Task rows with their download metadata (caseid, tname, status, attempts, bytes): absent and ambiguous win."""
    m = metadata.select("caseid", "tname", F.col("status").alias("_st"), "attempts", "bytes")
    j = tasks.join(m, ["caseid", "tname"], "left")
    final = (F.when(F.col("status") == "absent", "track_absent").when(F.col("status") == "ambiguous", "ambiguous_multiple_tids")
             .otherwise(F.coalesce("_st", F.lit("not_completed"))))
    used = F.col("status") == "ok"
    return j.select("caseid", "tname", "ids", final.alias("download_status"),
                    F.when(used, F.coalesce("attempts", F.lit(0))).otherwise(0).alias("attempts"),
                    F.when(used, F.coalesce("bytes", F.lit(0))).otherwise(0).alias("bytes"))


# Accepted source column names per field.
SOURCE_FIELDS = {
    "subjectid": ("subjectid",), "age": ("age",), "sex": ("sex",), "height": ("height",), "weight": ("weight",), "bmi": ("bmi",), "asa": ("asa",),
    "anesthesia_type": ("anetype", "ane_type", "anesthesia_type"), "operation_type": ("optype", "operation_type"),
    "emergency_status": ("emop", "emergency_status"),
    "anesthesia_start": ("anestart", "ane_start", "anesthesia_start"), "anesthesia_end": ("aneend", "ane_end", "anesthesia_end"),
    "operation_start": ("opstart", "op_start", "operation_start"), "operation_end": ("opend", "op_end", "operation_end"),
}
NUMERIC_FIELDS = ("age", "height", "weight", "bmi", "anesthesia_start", "anesthesia_end", "operation_start", "operation_end")


def parse_clinical(rows: DataFrame) -> DataFrame:
    """Typed clinical fields of text rows; ``parse_error`` names the first field that is not a finite number."""
    cols = rows.columns
    raw = {f: first_present(cols, names).cast("string") for f, names in SOURCE_FIELDS.items()}
    error = F.coalesce(*[F.when(number_class(raw[f]) == "invalid", F.lit(f"invalid numeric {f}")) for f in NUMERIC_FIELDS])
    return rows.select("caseid", *[(clean_number(c) if f in NUMERIC_FIELDS else clean_text(c)).alias(f) for f, c in raw.items()],
                       error.alias("parse_error"))


def eligibility_manifest(universe: DataFrame, clinical: DataFrame, tracks: DataFrame, reg: DataFrame, concepts: Sequence[str],
                         prior: DataFrame | None = None) -> DataFrame:
    """One row per expected case: fields, track availability, sorted reason flags, audit status, ordered failures.

    ``clinical`` is the output of ``parse_clinical``; ``concepts`` must all be
    present once.  ``prior`` (caseid) marks cases of an earlier study.
    """
    fields = list(SOURCE_FIELDS)
    one = clinical.groupBy("caseid").agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct(*fields, "parse_error")).alias("_c"))
    matched = with_concept(tracks, reg)
    per = matched.groupBy("caseid").agg(*[F.count_if(F.col("concept") == c).alias(f"_n_{c}") for c in concepts])
    listed = tracks.select("caseid").distinct().withColumn("_listed", F.lit(True))
    j = universe.join(one, "caseid", "left").join(per, "caseid", "left").join(listed, "caseid", "left")
    if prior is not None:
        j = j.join(prior.select("caseid").distinct().withColumn("_prior", F.lit(True)), "caseid", "left")
    prior_flag = F.coalesce(F.col("_prior"), F.lit(False)) if prior is not None else F.lit(None).cast("boolean")
    rows_n = F.coalesce("_rows", F.lit(0))
    good = (rows_n == 1) & F.col("_c.parse_error").isNull()
    j = j.select("caseid", "_rows", "_c", *[f"_n_{c}" for c in concepts], "_listed", prior_flag.alias("prior_case"),
                 *[F.when(good, F.col(f"_c.{f}")).alias(f) for f in fields])
    listed_ok = F.coalesce("_listed", F.lit(False))
    adult = F.coalesce(F.col("age") >= 18, F.lit(False))
    valid = valid_interval("anesthesia_start", "anesthesia_end") & valid_interval("operation_start", "operation_end")
    good = (rows_n == 1) & F.col("_c.parse_error").isNull()
    flags = [F.when(good & F.col(f).isNull(), F.lit(f"{f}_missing")) for f in ("age", "sex", "height", "weight")]
    flags += [F.when(good & ~adult, F.lit("adult_criterion_not_met")), F.when(good & ~valid, F.lit("time_range_order_invalid_or_missing")),
              F.when(~listed_ok, F.lit("track_inventory_missing")),
              F.when(F.col("prior_case").isNull(), F.lit("prior_overlap_not_evaluated")).when(F.col("prior_case"), F.lit("prior_case"))]
    for c in concepts:
        n = F.coalesce(f"_n_{c}", F.lit(0))
        flags += [F.when(n == 0, F.lit(f"{c}_track_missing")), F.when(n > 1, F.lit(f"{c}_track_ambiguous"))]
    failures = F.array_compact(F.array(
        F.when(rows_n == 0, F.lit("clinical_metadata_missing")).when(rows_n > 1, F.lit("duplicate_clinical_rows"))
        .when(F.col("_c.parse_error").isNotNull(), F.concat(F.lit("clinical_parse_error:"), F.col("_c.parse_error"))),
        F.when(~listed_ok, F.lit("track_inventory_missing"))))
    return j.select(
        "caseid", (rows_n == 1).alias("clinical_available"), listed_ok.alias("inventory_available"), *fields,
        *[F.col(f).isNotNull().alias(f"{f}_available") for f in ("age", "sex", "height", "weight")],
        adult.alias("adult_candidate"), "prior_case",
        *[(F.coalesce(f"_n_{c}", F.lit(0)) > 0).alias(f"{c}_available") for c in concepts],
        F.array_sort(F.array_distinct(F.array_compact(F.array(*flags)))).alias("flags"), failures.alias("failures"),
    ).withColumn("audit_status", F.when(F.size("failures") > 0, "failed").otherwise("complete")).withColumn(
        "failure_type", F.when(F.size("failures") > 0, F.split_part(F.col("failures")[0], F.lit(":"), F.lit(1))))


def audit_summary(manifest: DataFrame, concepts: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(measure, cases): every conditional count of the manifest from one aggregate."""
    cells = {
        "records": F.count(F.lit(1)), "audit_complete": F.count_if(F.col("audit_status") == "complete"),
        "audit_failed": F.count_if(F.col("audit_status") == "failed"), "clinical_available": F.count_if("clinical_available"),
        "inventory_available": F.count_if("inventory_available"),
        **{f"missing_{f}": F.count_if(F.col(f).isNull()) for f in fields}, **{f"available_{c}": F.count_if(f"{c}_available") for c in concepts}}
    one = manifest.agg(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("cases")) for n, c in cells.items()]).alias("_c"))
    return one.select(F.explode("_c").alias("_c")).select("_c.*")


def frequency(rows: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    """(value, cases) with missing labelled."""
    return rows.groupBy(missing_label(column, missing).alias("value")).agg(F.count(F.lit(1)).alias("cases"))


def crosstab(rows: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """Counts per 'field=value|...' key over the given encoded columns."""
    key = F.concat_ws("|", *[F.concat(F.lit(f"{n}="), missing_label(c)) for n, c in parts.items()])
    return rows.groupBy(key.alias("combination")).agg(F.count(F.lit(1)).alias("cases"))


def encoded(kind: str, column: str) -> Column:
    """Text of a flag ('0'/'1') or of the adult tri-state."""
    return adult_label(column) if kind == "adult" else F.col(column).cast("int").cast("string")


def funnel(rows: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, remaining, lost) for sequential criteria, from one aggregate.

    A null criterion fails.
    """
    so_far = F.lit(True)
    cells = [F.struct(F.lit(0).alias("step_no"), F.lit("all").alias("step"), F.count(F.lit(1)).alias("remaining"), F.lit(0).cast("bigint").alias("lost"))]
    before = F.count(F.lit(1))
    for i, (name, cond) in enumerate(steps, 1):
        so_far = so_far & F.coalesce(cond, F.lit(False))
        left = F.count_if(so_far)
        cells.append(F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), left.alias("remaining"), (before - left).alias("lost")))
        before = left
    return rows.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def analysis_universe(manifest: DataFrame, presence_rows: DataFrame, concepts: Sequence[str], anesthesia_type: str = "General") -> DataFrame:
    """Adult cases of one type with every concept present, next to their presence columns."""
    keep = F.col("adult_candidate") & (F.col("anesthesia_type") == anesthesia_type)
    for c in concepts:
        keep = keep & F.col(f"{c}_available")
    return manifest.where(keep).select("caseid", "anesthesia_start", "anesthesia_end").join(presence_rows, "caseid")


def pre_quality_manifest(universe: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Ordered exclusion reasons per case; included exactly where none applies."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return universe.select("caseid", reasons.alias("reasons")).withColumn("included", F.size("reasons") == 0)
