"""From raw documents to packed training text: each stage calls its operator in tracksieve/llm over all rows.

A stage is a function (spark, rows of the stage before, folder of the tables) -> rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.llm.line_dedup import drop_boilerplate
from tracksieve.llm.mixing import length_weight, mix
from tracksieve.llm.near_dedup import drop_copies
from tracksieve.llm.packing import pack
from tracksieve.llm.quality_rules import apply_rules
from tracksieve.llm.workspace import stored, table

#: Columns that go through all stages.
COLUMNS = ("doc_id", "source", "lang", "text")


def quality(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every rule."""
    # written before the filter: pushed into the rules, it would repeat their nested expressions many times over
    judged = stored(apply_rules(df.select(*COLUMNS)).select(*COLUMNS, "kept"), "judged")
    return judged.filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    return drop_boilerplate(df).select(*COLUMNS)


def near_dedup(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return drop_copies(df).select(*COLUMNS)


def mixing(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for, numbered by ``copy``."""
    mixed = mix(df, weight=length_weight()).filter(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("copy", *COLUMNS)


def packing(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """All copies in pieces, each with its bin and its place there."""
    return pack(df, ["doc_id", "copy"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: None: SQL cannot restate sketches, alignment and the packing plan; tests/test_corpus.py checks the stages instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        df = stored(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
