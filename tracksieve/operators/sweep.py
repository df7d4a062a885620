"""One-pass sweep over many preprocessing-rule combinations.

Alignment runs once.  Each age is replaced by the smallest cap class that admits
it, endpoints collapse to counts per class tuple, and every candidate's figures
follow from those counts, so the cost does not depend on the number of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksieve.functions.columns import candidate_id
from tracksieve.functions.quantiles import RECORD_QUANTILES, distribution
from tracksieve.operators.align import EPS_AGE, age
from tracksieve.operators.ordered import SEG, tasks_for
from tracksieve.session import cut_lineage

NEVER = float("inf")
KEY = ("rule", "signal_cap", "rate_cap")
FAILURES = ("history_signal_unavailable", "history_rate_a_unavailable", "history_rate_b_unavailable", "target_signal_unavailable")


def cap_class(a: Column, caps: Sequence[float]) -> Column:
    """Index of the smallest cap that admits the age; len(caps) if none does."""
    out = F.lit(len(caps))
    for i in range(len(caps) - 1, -1, -1):
        out = F.when(a <= F.lit(float(caps[i]) + EPS_AGE), F.lit(i)).otherwise(out)
    return out


def _cap_class(a: str, caps: Sequence[float]) -> str:
    """``cap_class`` as text."""
    return "CASE " + " ".join(f"WHEN {a} <= {float(cap) + EPS_AGE!r}D THEN {i}" for i, cap in enumerate(caps)) + f" ELSE {len(caps)} END"


def _ages(name: str, blocking: bool) -> tuple[str, str]:
    """Age of the usable value, and the same only where it comes from a duplicated timestamp (else infinite)."""
    usable = f"{name} IS NOT NULL" + (f" AND {name}.v >= 0" if blocking else "")
    return tuple(f"CASE WHEN {on} THEN g - {name}.t ELSE double('infinity') END" for on in (usable, f"{usable} AND {name}.dup"))


def endpoint_classes(
    aligned: DataFrame, rules: Sequence[str], rates: tuple[str, str],
    signal_caps: Sequence[float], rate_caps: Sequence[float], history: int, target: int,
) -> DataFrame:
    """(caseid, rule, hs, ha, hb, ts, ds, dr, endpoints): endpoints of every grid segment of a case, collapsed by cap class.

    hs/ha/hb: worst class over the history of signal and rates; ts: class of the
    target; ds/dr: best class of a duplicate-derived usable point.
    """
    # Text expressions: one call each instead of one for every operator inside.
    part = f"PARTITION BY caseid, {SEG} ORDER BY slot"
    back, ahead = f"OVER ({part} ROWS BETWEEN {history - 1} PRECEDING AND CURRENT ROW)", f"OVER ({part})"
    base = aligned.selectExpr("caseid", SEG, "slot", "k", "n", "_home", *[
        f"{c} AS {p}{x}" for x in (*rules, *rates) for p, c in zip(("a_", "d_"), _ages(x, x in rates))])
    framed = base.selectExpr(
        "caseid", SEG, "k", "n", "_home", *[f"max(a_{x}) {back} AS h_{x}" for x in (*rules, *rates)], *[f"min(d_{x}) {back} AS m_{x}" for x in (*rules, *rates)],
        *[f"lead({p}{x}, {target}) {ahead} AS t{p}{x}" for x in rules for p in ("a_", "d_")])
    ends = framed.where(f"_home AND k >= {history - 1} AND k < n - {target}")
    a, b = rates
    shared = {"ha": (f"h_{a}", rate_caps), "hb": (f"h_{b}", rate_caps), "dr": (f"least(m_{a}, m_{b})", rate_caps)}
    per_rule = ", ".join(
        f"named_struct('rule', '{x}', 'hs', {_cap_class(f'h_{x}', signal_caps)}, 'ts', {_cap_class(f'ta_{x}', signal_caps)}, "
        f"'ds', {_cap_class(f'least(m_{x}, td_{x})', signal_caps)})" for x in rules)
    return (
        ends.selectExpr("caseid", SEG, *[f"{_cap_class(c, caps)} AS {n}" for n, (c, caps) in shared.items()], f"explode(array({per_rule})) AS _r")
        # The grid lies by case and segment already, so no shuffle follows; the readers add the segments up.
        .groupBy("caseid", SEG, "_r.rule", "_r.hs", "ha", "hb", "_r.ts", "_r.ds", "dr").agg(F.count(F.lit(1)).alias("endpoints")).drop(SEG))


def _candidates(signal_caps: Sequence[float], rate_caps: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(
        f"named_struct('si', {i}, 'signal_cap', {int(sc)}L, 'ri', {j}, 'rate_cap', {int(rc)}L)" for i, sc in enumerate(signal_caps) for j, rc in enumerate(rate_caps)) + ")")


def _per_candidate(classes: DataFrame, signal_caps: Sequence[float], rate_caps: Sequence[float]) -> DataFrame:
    c = classes.withColumn("_c", F.explode(_candidates(signal_caps, rate_caps))).select("*", "_c.*").drop("_c")
    si, ri = F.col("si"), F.col("ri")
    return c.select(
        "caseid", *KEY, "endpoints", (F.col("hs") <= si).alias("s"), (F.col("ha") <= ri).alias("a"), (F.col("hb") <= ri).alias("b"),
        (F.col("ts") <= si).alias("t"), ((F.col("ds") <= si) | (F.col("dr") <= ri)).alias("dup"))


def sweep_counts(classes: DataFrame, cases: DataFrame, rules: Sequence[str], signal_caps: Sequence[float], rate_caps: Sequence[float]) -> DataFrame:
    """Per case and candidate: usable history, targets, windows, failures, duplicate-affected endpoints.

    Cases without any endpoint keep their rows with zero counts; ``cases`` holds every case of ``classes``.
    """
    cells = {"usable_history": "s AND a AND b", "usable_targets": "t", "usable_windows": "s AND a AND b AND t",
             **{f"fail_{x}": f"NOT {x}" for x in "sabt"}, "duplicate_affected": "dup"}
    # A row without endpoints for every case and rule takes the place of a join with all candidates.
    cases = cut_lineage(cases.select("caseid"))
    never = {**{x: len(signal_caps) for x in ("hs", "ts", "ds")}, **{x: len(rate_caps) for x in ("ha", "hb", "dr")}}
    empty = cases.select("caseid", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"), *[F.lit(i).alias(x) for x, i in never.items()], F.lit(0).cast("bigint").alias("endpoints"))
    rows = cases.count() * len(rules) * len(signal_caps) * len(rate_caps)
    whole = classes.unionByName(empty).repartition(tasks_for(cases, rows), "caseid", "rule")
    found = _per_candidate(whole, signal_caps, rate_caps).groupBy("caseid", *KEY).agg(
        F.sum("endpoints").alias("endpoints"), *[F.expr(f"sum(CASE WHEN {on} THEN endpoints ELSE 0 END) AS {name}") for name, on in cells.items()])
    return found.withColumn("candidate_id", candidate_id(F.col("rule"), F.col("signal_cap"), F.col("rate_cap")))


def sweep_overlaps(classes: DataFrame, signal_caps: Sequence[float], rate_caps: Sequence[float]) -> DataFrame:
    """Endpoints per candidate and failure-reason combination ('PASS' where none fails)."""
    reasons = F.concat_ws("|", *[F.when(~F.col(x), F.lit(r)) for x, r in zip("sabt", FAILURES)])
    return (
        _per_candidate(classes, signal_caps, rate_caps)
        .groupBy(*KEY, F.when(reasons == "", "PASS").otherwise(reasons).alias("combination"))
        .agg(F.sum("endpoints").alias("endpoints")))


def sweep_summary(counts: DataFrame) -> DataFrame:
    """Candidate totals over cases, zero-window cases and the distribution of windows per case."""
    sums = ("endpoints", "usable_history", "usable_targets", "usable_windows", "fail_s", "fail_a", "fail_b", "fail_t")
    totals = counts.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col("usable_windows") > 0).alias("usable_cases"), F.count_if(F.col("usable_windows") == 0).alias("zero_window_cases"))
    spread = distribution(counts.select("candidate_id", "usable_windows"), ["candidate_id"], "usable_windows", RECORD_QUANTILES)
    return totals.join(spread.drop("available_count", "missing_count"), "candidate_id")


def minimum_window_sensitivity(counts: DataFrame, minimums: Sequence[int]) -> DataFrame:
    """Pass and fail cases per candidate and minimum window count, from one aggregate."""
    w = F.col("usable_windows")
    per = counts.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_n"), F.array(*[
        F.struct(F.lit(m).cast("bigint").alias("minimum"), F.count_if(w >= m).alias("pass_cases")) for m in minimums]).alias("_m"))
    return per.select("candidate_id", "_n", F.explode("_m").alias("_m")).select(
        "candidate_id", "_m.minimum", "_m.pass_cases", (F.col("_n") - F.col("_m.pass_cases")).alias("fail_cases"),
        (F.col("_m.pass_cases") / F.col("_n")).alias("pass_fraction"))


def rate_alignment(aligned: DataFrame, rates: Sequence[str], rate_caps: Sequence[float]) -> DataFrame:
    """Grid points per rate track, hold cap and outcome; points collapse before the caps are applied."""
    home = aligned.where("_home")
    entry = F.array(*[F.struct(F.lit(x).alias("track"), F.col(x).alias("o"), age(x).alias("age")) for x in rates])
    v = F.col("_e.o.v")
    kind = F.when(v.isNull(), "no_prior").when(v < 0, "negative").when(v > 0, "positive").otherwise("zero")
    few = home.select(F.explode(entry).alias("_e")).groupBy(
        F.col("_e.track").alias("track"), kind.alias("kind"), F.coalesce(F.col("_e.o.dup"), F.lit(False)).alias("dup"),
        cap_class(F.coalesce(F.col("_e.age"), F.lit(NEVER)), rate_caps).alias("cls")).agg(F.count(F.lit(1)).alias("c"))
    caps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).cast("bigint").alias("hold_cap")) for i, c in enumerate(rate_caps)])
    each = few.withColumn("_p", F.explode(caps)).select("*", "_p.*")
    valued = F.col("kind").isin("positive", "zero")
    fits = F.col("cls") <= F.col("i")
    c = F.col("c")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, c).otherwise(0))

    return each.groupBy("track", "hold_cap").agg(
        F.sum(c).alias("grid_points"), total(valued & fits).alias("usable"), total(~(valued & fits)).alias("unavailable"),
        total((F.col("kind") == "positive") & fits).alias("usable_positive"), total((F.col("kind") == "zero") & fits).alias("usable_zero"),
        total(valued & ~fits).alias("hold_cap_exceeded"), total(F.col("kind") == "negative").alias("latest_negative"),
        total(F.col("kind") == "no_prior").alias("no_prior"), total(valued & fits & F.col("dup")).alias("duplicate_used"),
    ).withColumn("usable_fraction", F.col("usable") / F.col("grid_points"))


WORD = 63  # flags in one word of a bit set


def _words(n: int) -> int:
    return -(-n // WORD)


def pass_masks(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """(mask, cases): cases collapsed by their pattern over any number of boolean columns, as words of 63 bits."""
    def word(w: int) -> str:
        return " | ".join(f"CASE WHEN `{n}` THEN {1 << i}L ELSE 0L END" for i, n in enumerate(names[w * WORD:(w + 1) * WORD]))

    return flags.groupBy(F.expr(f"array({', '.join(word(w) for w in range(_words(len(names))))})").alias("mask")).agg(F.count(F.lit(1)).alias("cases"))


def disagreement(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Full matrix of pairwise disagreement counts (left, right, disagreements).

    Works on patterns: a pattern with flag i set becomes, word by word, the bits that differ from
    i, so one aggregate row per left flag counts all right flags and no pairs of cases exist.
    """
    left = masks.select("mask", "cases", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i"))
    mine = f"getbit(element_at(mask, cast(i div {WORD} as int) + 1), i % {WORD})"
    differ = left.selectExpr("i", "cases", f"transform(mask, w -> CASE WHEN {mine} = 1 THEN w ^ {(1 << WORD) - 1}L ELSE w END) AS x")
    sums = differ.groupBy("i").agg(*[
        F.expr(f"sum(CASE WHEN getbit(x[{j // WORD}], {j % WORD}) = 1 THEN cases ELSE 0L END) AS _{j}") for j in range(len(names))])
    label = F.array(*[F.lit(n) for n in names])
    out = sums.select(F.get(label, F.col("i")).alias("left"), F.posexplode(F.array(*[f"_{j}" for j in range(len(names))])).alias("j", "disagreements"))
    return out.select("left", F.get(label, F.col("j")).alias("right"), "disagreements")


def candidate_masks(counts: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(mask, cases) of 'at least one usable window' over the candidates of each case; any number of candidates."""
    place = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("candidate_id")) - 1
    bit = F.when(F.col("usable_windows") > 0, F.expr(f"shiftleft(1L, cast(_at % {WORD} as int))")).otherwise(F.lit(0).cast("bigint"))
    per = counts.withColumn("_at", place).where(F.col("_at") >= 0).withColumn("_bit", bit).groupBy("caseid").agg(*[
        F.expr(f"bit_or(CASE WHEN _at div {WORD} = {w} THEN _bit ELSE 0L END) AS _{w}") for w in range(_words(len(candidates)))])
    return per.groupBy(F.array(*[f"_{w}" for w in range(_words(len(candidates)))]).alias("mask")).agg(F.count(F.lit(1)).alias("cases"))


def _by_case(scenarios: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts joined with the scenario rows of their case, in tasks by the rows of the counts."""
    held = cut_lineage(counts.select("caseid", "candidate_id", "usable_windows"))
    tasks = tasks_for(held, held.count())
    return held.repartition(tasks, "caseid").join(scenarios.repartition(tasks, "caseid"), "caseid")


def scenario_confusion(scenarios: DataFrame, counts: DataFrame, minimums: Sequence[int]) -> DataFrame:
    """Scenario verdict against window minimum per candidate: the four cells and pass-but-zero-window.

    ``scenarios`` is (caseid, scenario, passes, reasons); both sides have a fixed
    number of rows per case, so the join stays linear in cases.
    """
    j = _by_case(scenarios.select("caseid", "scenario", "passes"), counts)
    p, w = F.col("passes"), F.col("usable_windows")
    per = j.groupBy("scenario", "candidate_id").agg(
        F.count_if(p & (w == 0)).alias("pass_but_zero"), F.array(*[F.struct(
            F.lit(m).cast("bigint").alias("minimum"), F.count_if(p & (w < m)).alias("pass_but_below"),
            F.count_if(~p & (w >= m)).alias("fail_but_meets"), F.count_if(p & (w >= m)).alias("both_pass"),
            F.count_if(~p & (w < m)).alias("both_fail")) for m in minimums]).alias("_m"))
    return per.select("scenario", "candidate_id", "pass_but_zero", F.explode("_m").alias("_m")).select(
        "scenario", "candidate_id", "pass_but_zero", "_m.*")


def reasons_among_fail_but_meets(scenarios: DataFrame, counts: DataFrame, minimums: Sequence[int]) -> DataFrame:
    """Failure reasons of the cases a scenario rejects although the candidate meets the minimum."""
    w = F.col("usable_windows")
    j = _by_case(scenarios.where(~F.col("passes")), counts)
    per = j.select("scenario", "candidate_id", "usable_windows", F.explode("reasons").alias("reason")).groupBy(
        "scenario", "candidate_id", "reason").agg(F.array(*[
            F.struct(F.lit(m).cast("bigint").alias("minimum"), F.count_if(w >= m).alias("cases")) for m in minimums]).alias("_m"))
    return per.select("scenario", "candidate_id", "reason", F.explode("_m").alias("_m")).select(
        "scenario", "candidate_id", "reason", "_m.*").where(F.col("cases") > 0)
