"""Cohort and signal-audit analytics over irregular per-entity time series, on Spark.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame``.  Nothing
here collects case-level rows to the driver, and no operator puts a whole key
into one task: ordered work runs on bounded segments (``operators.ordered``).
"""
