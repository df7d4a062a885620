"""Operators that prepare training text: sharding, deduplication, quality, mixing, packing.

Every module holds one operator with its own general interface and the query
that applies it to a whole table.  Only ``__spark_entry__`` and ``corpus_pipeline`` import it.
"""
