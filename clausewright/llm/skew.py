"""Joins in which a key may hold a large share of all rows.

A key with more than a HEAVY_SHAREth of the rows is heavy; there are HEAVY_SHARE heavy keys at most, so what is said of them can be
sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 10_000


def joined(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """``rows`` joined to ``table`` (one narrow row for each key; ``weight``: how many rows have it) so that no heavy key meets
    in one task: their rows of ``table`` are sent to ``rows``, the others are joined as Spark sees fit."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY_SHARE > total
    light = rows.join(table.where(~heavy).drop(weight), key)
    return light.unionByName(rows.join(F.broadcast(table.where(heavy).drop(weight)), key))


def joined_salted(rows: DataFrame, table: DataFrame, key: str, other: str, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (one row for each key, however wide): the rows of a heavy key are dealt out by ``other`` in
    parts of about a HEAVY_SHAREth of all, and the key's row of ``table`` goes to each part. ``counted``: a table with the same
    keys that is cheaper to count than ``rows``."""
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("skew_n"))
    total = counts.agg(F.sum("skew_n")).first()[0] or 0
    parts = F.ceil(F.col("skew_n") * HEAVY_SHARE / max(1, total)).cast("int")
    heavy = F.broadcast(counts.where(F.col("skew_n") * HEAVY_SHARE > total).select(key, parts.alias("skew_parts")))
    salted = rows.join(heavy, key, "left").withColumn("skew_salt", F.coalesce(F.pmod(F.xxhash64(other), "skew_parts"), F.lit(0)).cast("int"))
    spread = table.join(heavy, key, "left").withColumn("skew_salt", F.explode(F.sequence(F.lit(0), F.coalesce("skew_parts", F.lit(1)) - 1)))
    return salted.drop("skew_parts").join(spread.drop("skew_parts"), [key, "skew_salt"]).drop("skew_salt")
