"""Packing into bins of variable capacity: best fit decreasing on size classes, with the capacities chosen together.

Sizes are words.  A text above the largest capacity is cut into consecutive pieces of
that capacity and a rest; pieces joined in order give the text again.  Pieces go, by
falling size, into the bin with the least room that still holds them, and a new bin is
opened when there is none, at the capacity that is set for the band of the size (sizes
that need the same smallest capacity).  All settings are planned (24 for four capacities);
at the end of each a bin takes the smallest capacity that holds its content.  The plan taken has
the least capacity in all; among equal ones, the fewest bins.

The plan needs only the count of pieces of each size, at most the largest capacity's
number of rows: equal pieces are placed in runs and equal bins are kept as one class.
Rows find their place by their number within their size class; the classes are
numbered in cells, so none is ordered in one task.

Cases: a text without a word, null too, is one piece of size 0 without a bin; ids are
unique and not null; an empty table gives an empty table; other
columns pass unchanged, and input columns named like a result column are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksieve.llm.mixing import word_count
from tracksieve.llm.workspace import stored, table

CAPACITIES = (256, 512, 1024, 2048)
CELLS = 512
ADDED = ("piece", "size", "bin", "start", "filled", "capacity")
#: A word with the separators after it, the first one also with those before it.
_WORDS = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def plan(counts: dict[int, int], opened: int | Mapping[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first, rows, bin, each, start) for ``counts`` of pieces by size.

    ``opened`` is the capacity of a new bin, for all or by size.
    A run puts ``rows`` pieces of ``size``, numbered from ``first``, into consecutive bins from ``bin``,
    ``each`` pieces in one, the first of them at word ``start``.
    """
    runs, bins = [], 0
    free: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, capacity)
    rooms: list[int] = []

    def leave(room: int, first: int, many: int, capacity: int) -> None:
        if room not in free:
            bisect.insort(rooms, room)
        free.setdefault(room, []).append((first, many, capacity))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        at, left = 0, counts[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, many, capacity = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                capacity = opened if isinstance(opened, int) else opened[size]
                room, first, many = capacity, bins, -(-left // (capacity // size))
                bins += many
            each = min(room // size, left)
            used = min(many, left // each)
            runs.append((size, at, used * each, first, each, capacity - room))
            at, left = at + used * each, left - used * each
            if many > used:
                leave(room, first + used, many - used, capacity)
            leave(room - each * size, first, used, capacity)
    return runs


def shrunk(runs: list[tuple[int, int, int, int, int, int]], capacities: tuple[int, ...]) -> tuple[int, int]:
    """(capacity, bins) of a plan in all, with every bin at the smallest of ``capacities`` that holds it."""
    ends = [(first, first + rows // each, start + each * size) for size, _, rows, first, each, start in runs]
    borders = sorted({x for first, after, _ in ends for x in (first, after)})
    place = {x: i for i, x in enumerate(borders)}
    most = [0] * len(borders)
    for first, after, end in ends:
        for i in range(place[first], place[after]):
            most[i] = max(most[i], end)
    order, total, bins = sorted(capacities), 0, 0
    for i, end in enumerate(most[:-1]):
        if end:
            many = borders[i + 1] - borders[i]
            total, bins = total + many * order[bisect.bisect_left(order, end)], bins + many
    return total, bins


def best_plan(counts: dict[int, int], capacities: tuple[int, ...]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan of least capacity over all settings of the opening capacities by band; among equal ones, that of fewest bins."""
    order = sorted(capacities)
    sizes = [s for s in counts if s > 0]
    band = {s: bisect.bisect_left(order, s) for s in sizes}
    there = sorted(set(band.values()))
    plans = []
    for chosen in product(*[order[b:] for b in there]):
        setting = dict(zip(there, chosen))
        runs = plan(counts, {s: setting[band[s]] for s in sizes})
        plans.append((*shrunk(runs, capacities), runs))
    return min(plans, key=lambda p: p[:2])[2]


def place(df: DataFrame, idents: list[str], text: str = "text", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(``idents``, piece, size, bin, start, filled, capacity) of every piece; ``start`` is its first word in the bin."""
    spark, largest = df.sparkSession, max(capacities)
    cut = df.select(*idents, word_count(F.col(text)).alias("_words")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_words") - 1) / largest)).cast("int"))))
    cut = cut.withColumn("size", F.least(F.lit(largest), F.col("_words") - F.col("piece") * largest).cast("bigint")).drop("_words")
    cut = stored(cut.withColumn("_cell", F.pmod(F.xxhash64(*idents, "piece"), F.lit(CELLS))), "pieces")
    cells = stored(cut.groupBy("size", "_cell").agg(F.count(F.lit(1)).alias("_n")), "cells")
    counts = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("_n").alias("n")).collect()}  # at most ``largest`` + 1 rows
    by_size: dict[int, list] = {}
    for size, *rest in best_plan(counts, capacities):
        by_size.setdefault(size, []).append(tuple(rest))
    laid = spark.createDataFrame(list(by_size.items()), "size bigint, _runs array<struct<first:bigint,rows:bigint,bin:bigint,each:bigint,start:bigint>>")
    before = cells.select("size", "_cell", (F.sum("_n").over(Window.partitionBy("size").orderBy("_cell")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy("size", "_cell").orderBy(*idents, "piece")) - 1
    placed = cut.withColumn("_here", here).join(before, ["size", "_cell"]).withColumn("_at", F.col("_before") + F.col("_here"))
    placed = placed.join(F.broadcast(laid), "size", "left").withColumn("_run", F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_at")), -1))
    nth = F.col("_at") - F.col("_run.first")
    placed = placed.withColumns({
        "bin": (F.col("_run.bin") + F.floor(nth / F.col("_run.each"))).cast("bigint"),
        "start": (F.col("_run.start") + F.pmod(nth, F.col("_run.each")) * F.col("size")).cast("bigint")}).select(*idents, "piece", "size", "bin", "start")
    # pieces without a bin are dealt out, as they would meet under one null
    own = F.coalesce("bin", -1 - F.pmod(F.xxhash64(*idents), F.lit(CELLS)))
    filled = F.when(F.col("bin").isNotNull(), F.sum("size").over(Window.partitionBy(own)))
    least = F.least(*[F.when(F.col("filled") <= c, F.lit(c)) for c in sorted(capacities)], F.lit(None))
    return placed.withColumn("filled", filled).withColumn("capacity", least)


def pack(df: DataFrame, idents: list[str], text: str = "text", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row for every piece: the columns of ``df`` with ``text`` cut to the piece, and those of ``place``."""
    largest, df = max(capacities), df.drop(*ADDED)
    placed = stored(place(df, idents, text, capacities), "placed")
    whole = placed.groupBy(*idents).agg(F.collect_list(F.struct(*ADDED)).alias("_pieces"))  # as many as the text has
    rows = df.join(whole, idents).withColumn("_words", F.when(F.size("_pieces") > 1, F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))))
    rows = rows.withColumn("_piece", F.explode("_pieces"))
    part = F.array_join(F.slice("_words", F.col("_piece.piece") * largest + 1, F.lit(largest)), "")
    return rows.withColumn(text, F.when(F.col("_words").isNull(), F.col(text)).otherwise(part)).select(*df.columns, "_piece.*")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return place(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
