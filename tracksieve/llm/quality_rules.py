"""Quality rules: a table of thresholds compiled into one projection.

``RULES`` names a ratio, a lower and an upper bound.  ``measures`` adds the counts
of a text as columns, ``compiled`` turns the rules into one boolean expression per
rule, and ``apply_rules`` returns counts, ratios, the failed rules and the verdict.
Everything is a built-in expression of one row: no shuffle, no user function.

Cases: a null text counts as an empty one and fails the base rules; ties do not
occur; repeated rows are judged one by one; an empty table gives an empty table;
columns of the input that share a name with a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.workspace import WORD_BREAK, table


class Rule(NamedTuple):
    ratio: str
    least: float | None = None
    most: float | None = None


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "das der die ein eine für ich im ist mit nicht sich und von zu auf "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "con del el los las no para por se su y al lo como más"
).split()

RULES = (
    Rule("chars_per_word", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("duplicate_line_share", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Names that the projection adds to the rows.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != "")


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` at ascending ``starts``."""
    gaps = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
    return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``COUNTS``; a repeated window is found by sorting window hashes, in n log n."""
    stops = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_body": body, "_words": _words(body)})
    n = F.size("_words")
    window = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns({
        "_windows": window,
        "_lines": F.filter(F.split("_body", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    df = df.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered))
    twice = F.filter(F.transform("_ordered", lambda e, i: F.when(
        (e["h"] == F.get("_ordered", i - 1)["h"]) | (e["h"] == F.get("_ordered", i + 1)["h"]), e["at"])), lambda p: p.isNotNull())
    df = df.withColumn("_starts", F.sort_array(twice))
    return df.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace("_body", WORD_BREAK, "")).cast("bigint"),
        "n_symbols": F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(_covered(F.col("_starts"), 3), F.lit(0)).cast("bigint"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("bigint"),
    }).drop("_body", "_words", "_windows", "_lines", "_ordered", "_starts")


def ratios() -> dict[str, Column]:
    """The ratios that rules may name; 0 where there is nothing to divide by."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "chars_per_word": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"), "duplicate_line_share": share("n_dup_lines", "n_lines")}


def compiled(rules: Sequence[Rule]) -> Column:
    """The names of the failed rules as one array expression; an unknown ratio is an error at once."""
    known = ratios()
    failed = []
    for rule in rules:
        value, bad = known[rule.ratio], F.lit(False)
        if rule.least is not None:
            bad = bad | (value < rule.least)
        if rule.most is not None:
            bad = bad | (value > rule.most)
        failed.append(F.when(bad, F.lit(rule.ratio)))
    return F.filter(F.array(*failed).cast("array<string>"), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, min_words: int = MIN_WORDS,
                max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Rows of ``df`` with counts, ratios, ``failed_rules``, ``base_failed`` and ``kept``."""
    counted = measures(df, text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (counted.withColumns(ratios() | {"failed_rules": compiled(rules), "base_failed": base})
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_stop_words", "n_lines")


_STOPS = ", ".join(f"'{w}', '{w.capitalize()}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words[pos], words[pos + 1], words[pos + 2]) AS n FROM t),
p AS (SELECT DISTINCT doc_id, pos + k AS pos FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2),
r AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop_words, len(lines) AS n_lines
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols / n_words <= 0.1
         AND n_stop_words / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept,
       CAST(n_stop_words AS BIGINT) AS n_stop_words, CAST(n_lines AS BIGINT) AS n_lines
FROM b"""
