"""Collects the registered queries of all plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


MODULES = (
    "alignment", "sequences", "sweeps", "exposure", "quality", "sampling", "guarding",
    "inventories", "distributions", "subjects", "cohorts", "schedules", "statistics_plans", "integrity_plans",
    "source_plans", "stream_plans", "store_plans",
)

#: Queries from outside this folder; ``__spark_entry__`` puts them here.
ADDED: dict[str, Query] = {}


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"tracksieve.plans.{name}")
        except ModuleNotFoundError as error:
            if error.name != f"tracksieve.plans.{name}":
                raise
            continue
        for key, query in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query registered twice: {key}")
            found[key] = query
    if twice := found.keys() & ADDED.keys():
        raise ValueError(f"query registered twice: {sorted(twice)}")
    return found | ADDED
