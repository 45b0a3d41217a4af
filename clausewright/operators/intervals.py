"""Joins of intervals with the points in them, by equality alone.

An interval of whole numbers is cut into the few blocks of the binary tree over all numbers that make it up: two for each level at
most, and disjoint. A point lies in one block of each level. So a point is in an interval exactly if one block is of both, and of no two:
pairs are found by an equi-join on group, level and block, each once, with nothing to filter after it and no group compared all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCKS = "array<struct<level:int,block:bigint>>"


def blocks(begin: Column, end: Column) -> Column:
    """array<struct<level, block>>: the blocks that make up begin..end (both included, from 0); none for an empty or null interval."""
    low, high = begin.cast("bigint"), end.cast("bigint") + 1
    fits = F.coalesce((low >= 0) & (low < high), F.lit(False))
    start = F.struct(low.alias("l"), high.alias("r"), F.array().cast(_BLOCKS).alias("out"))

    def step(state: Column, level: Column) -> Column:
        l, r, more = state["l"], state["r"], state["l"] < state["r"]  # noqa: E741
        left, right = more & (l % 2 == 1), more & (r % 2 == 1)
        own = F.array(F.when(left, F.struct(level.alias("level"), l.alias("block"))), F.when(right & ~(left & (l == r - 1)), F.struct(level.alias("level"), (r - 1).alias("block"))))
        return F.struct(F.shiftright(F.when(left, l + 1).otherwise(l), 1).alias("l"), F.shiftright(F.when(right, r - 1).otherwise(r), 1).alias("r"), F.concat(state["out"], F.array_compact(own)).alias("out"))

    levels = F.sequence(F.lit(0), levels_of(F.when(fits, high - low).otherwise(1)))
    return F.when(fits, F.aggregate(levels, start, step, lambda s: s["out"])).otherwise(F.array().cast(_BLOCKS))


def levels_of(size: Column) -> Column:
    """The highest level of a block within ``size`` numbers."""
    return F.ceil(F.log2(size.cast("double"))).cast("int") + 1


def in_intervals(intervals: DataFrame, points: DataFrame, keys: tuple[str, ...], begin: Column, end: Column, at: Column, largest: Column) -> DataFrame:
    """``intervals`` joined to the ``points`` that lie in them and have the same ``keys`` (none null). ``largest``: a column of ``points`` that no
    interval of its keys is longer than. The other columns' names must differ."""
    cut = intervals.withColumn("in_block", F.explode(blocks(begin, end)))
    there = F.transform(F.sequence(F.lit(0), levels_of(F.greatest(largest.cast("bigint"), F.lit(1)))), lambda k: F.struct(k.alias("level"), F.floor(at.cast("bigint") / F.pow(F.lit(2.0), k)).cast("bigint").alias("block")))
    placed = points.withColumn("in_block", F.explode(there))
    return cut.join(placed, [*keys, "in_block"]).drop("in_block")
