"""Structured Streaming forms of the event-by-event operators.

Results do not depend on how rows arrive in micro-batches, as long as rows are not older than
the watermark: events wait for the watermark and are then taken in event time, state ends with
the events it waits for, and outputs are appended or added up, never rewritten as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

ACCEPTANCE = "caseid bigint, seq bigint, t double, value double, mask double, age double, reason string"
#: Case ids that share a group, so that one call takes many short cases (a power of two, as an exponent).
CASES = 6
#: The latest accepted event of each case, and the events that wait for the watermark.
_STATE = ("good_case array<bigint>, good_t array<double>, good_v array<double>, "
          "caseid array<bigint>, t array<double>, seq array<bigint>, v array<double>, quality array<double>")


def _visible(events: pd.DataFrame, good: dict[int, tuple[float, float]], clip: float, cap: float, threshold: float) -> tuple[pd.DataFrame, dict[int, tuple[float, float]]]:
    """What is visible at each event, of rows by case and time, and the latest accepted event of each case afterwards."""
    case = events["caseid"].to_numpy(dtype=np.int64)
    t, v, q = (events[c].to_numpy(dtype=float) for c in ("t", "v", "quality"))
    reason = np.select(
        [np.isnan(v), (v < 0) | (v > 100), np.isnan(q), q < threshold],
        ["explicit_missing_event", "signal_out_of_range", "quality_missing_exact_timestamp", "quality_below_threshold"], "available").astype(object)
    first = np.flatnonzero(np.r_[True, case[1:] != case[:-1]])
    rows = np.diff(np.r_[first, len(case)])
    at = np.maximum.accumulate(np.where(reason == "available", np.arange(len(t)), -1))
    own = at >= np.repeat(first, rows)  # of the same case
    start = np.array([good.get(c, (np.nan, np.nan)) for c in case[first].tolist()])
    seen_t, seen_v = (np.where(own, x[at], np.repeat(start[:, i], rows)) for i, x in enumerate((t, v)))
    age = t - seen_t
    shown = age <= cap
    out = pd.DataFrame({
        "caseid": case, "seq": events["seq"].astype("int64"), "t": t, "value": np.where(shown, seen_v, 0.0), "mask": shown.astype(float),
        "age": np.where(shown, np.minimum(age, clip), 0.0),
        "reason": np.where(shown, "available", np.where(np.isnan(seen_t) | (t > seen_t), reason, "stale_beyond_cap"))})
    last = np.cumsum(rows) - 1
    accepted = {int(case[i]): (float(seen_t[i]), float(seen_v[i])) for i in last if not np.isnan(seen_t[i])}
    return out, {**good, **accepted}


def acceptance_stream(events: DataFrame, cap: float, clip: float, threshold: float = 50.0, delay: str = "1 day", base: float = 0.0, keep: float | None = None) -> DataFrame:
    """What is visible at each event: value, mask, age and reason.

    ``events`` is a stream of (caseid, seq, ts, t, v, quality) where ``ts`` is the timestamp
    of ``base + t`` seconds, after 1970.  An event waits until the watermark (``delay`` behind the latest one) has
    passed it; then all waiting events before it have come, and they are taken in time order.
    Older events are dropped and counted by Spark.  Neighbouring case ids share a group, as a call
    costs more than the events of a short case.  A case's state ends when nothing waits and
    ``keep`` seconds (the cap, if not given) have passed its latest accepted event, which no later
    event can then see.  Rows without a time ``t`` only move the watermark.
    """
    keep = cap if keep is None else keep

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["caseid", "t", "seq", "v", "quality"]
        good, parts = {}, [b[columns] for b in batches]
        if state.exists:
            cases, times, values, *waiting = map(list, state.get)
            good = dict(zip(cases, zip(times, values)))
            parts.insert(0, pd.DataFrame(dict(zip(columns, waiting))))
        mark = state.getCurrentWatermarkMs() / 1000.0 - base
        numbers = [p.assign(caseid=p["caseid"].fillna(0).astype("int64"), **{c: p[c].astype(float) for c in ("t", "v", "quality")}) for p in parts if len(p)]
        pdf = pd.concat(numbers, ignore_index=True) if numbers else pd.DataFrame(columns=columns)
        pdf = pdf[pdf["t"].notna()].sort_values(["caseid", "t", "seq"], kind="stable")
        ready = pdf["t"] <= mark
        if ready.any():
            out, good = _visible(pdf[ready], good, clip, cap, threshold)
            yield out if key[0] is not None else out.assign(caseid=None)
        rest = pdf[~ready]
        waits = set(rest["caseid"])
        good = {c: g for c, g in good.items() if c in waits or g[0] + keep > mark}
        if not len(rest) and not good:
            if state.exists:
                state.remove()
            return
        due = min([*rest["t"], *(g[0] + keep for c, g in good.items() if c not in waits)])
        number = lambda c: [None if np.isnan(x) else float(x) for x in rest[c].to_numpy(dtype=float)]
        state.update((list(good), [g[0] for g in good.values()], [g[1] for g in good.values()], [int(x) for x in rest["caseid"]],
                      number("t"), [int(x) for x in rest["seq"]], number("v"), number("quality")))
        state.setTimeoutTimestamp(int((max(due, mark) + base) * 1000) + 1)

    grouped = events.withWatermark("ts", delay).withColumn("_cases", F.shiftright("caseid", CASES)).groupBy("_cases")
    return grouped.applyInPandasWithState(step, ACCEPTANCE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ledger_parts(events: DataFrame) -> DataFrame:
    """Attempts and last status per task of one batch of (task, seq, status, retryable): a part that adds up."""
    return events.groupBy("task").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("seq").alias("last_seq"), F.max_by("status", "seq").alias("last_status"), F.max_by("retryable", "seq").alias("last_retryable"))


def ledger_table(parts: DataFrame) -> DataFrame:
    """The parts of all batches added up: (task, attempts, last_seq, last_status, last_retryable)."""
    return parts.groupBy("task").agg(
        F.sum("attempts").alias("attempts"), F.max("last_seq").alias("last_seq"),
        F.max_by("last_status", "last_seq").alias("last_status"), F.max_by("last_retryable", "last_seq").alias("last_retryable"))


def session_stream(events: DataFrame, match: Column, gap: str, delay: str = "1 day") -> DataFrame:
    """Gap-bounded runs of matching rows as session windows: (caseid, rows, first_ts, last_ts).

    ``events`` has caseid and a timestamp ``ts``; a gap of exactly ``gap`` still joins.  A run is
    appended, and its state ends, when the watermark has passed its end.  Rows without a case
    only move the watermark.
    """
    # The filter runs before the watermark is taken, so it must let those rows pass.
    m = events.withWatermark("ts", delay).where(match | F.col("caseid").isNull())
    return m.groupBy("caseid", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available and append finished rows to parquet at ``path``."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").format("parquet").option("path", path).start().awaitTermination()


def add_parts(stream: DataFrame, parts: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Drain what is available; each batch writes its ``parts`` to a folder of its own, which a repeated batch replaces."""
    def write(df: DataFrame, batch: int) -> None:
        parts(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def close_source(spark: SparkSession, folder: str, schema: str, ts: str = "ts") -> None:
    """Add a last row, all null but for a far event time, that moves the watermark past everything that waits."""
    last = spark.range(1).select(*[
        (F.to_timestamp(F.lit("2200-01-01")) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in StructType.fromDDL(schema).fields])
    last.write.mode("append").parquet(folder)
