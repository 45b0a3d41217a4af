"""As-of joins: rows with the latest event of their keys that isn't after them.

Rows and events are sorted together into ranges of about the same size, so that a key with a third of all rows is cut into many by time.
Within a range a window carries the last event on; across ranges only one key can go on from one to the next, so that what is carried over
is at most a row for each range.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.staging import staged


def as_of(rows: DataFrame, events: DataFrame, keys: tuple[str, ...], at: str, event_at: str, within: Column | None = None, prefix: str = "event_") -> DataFrame:
    """Each of ``rows`` once, with the columns of its event, named ``prefix`` and their names: of the ``events`` with the same ``keys`` the
    one with the latest ``event_at`` that isn't after the row's ``at``; at the same time the one that is greatest by its other columns in
    their order. They are null where there is none, or where it is more than ``within`` (an interval) before the row.

    Rows with a null key or a null time are kept and have no event; events with a null key or time are no row's. Equal rows stay
    apart. ``events`` must have columns that can be ordered (no maps), and prefixed names that ``rows`` don't have.
    """
    names = [f"key_{n}" for n in range(len(keys))]
    others = [c for c in events.columns if c not in keys]
    known = lambda frame, time: reduce(and_, (frame[c].isNotNull() for c in (*keys, time)))
    event = F.struct(*(events[c].alias(prefix + c) for c in others))
    nothing = F.struct(*(F.lit(None).cast(events.schema[c].dataType).alias(prefix + c) for c in others))

    right = events.where(known(events, event_at)).select(*(events[k].alias(n) for k, n in zip(keys, names, strict=True)), events[event_at].alias("time"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), event.alias("event"), F.lit(None).cast(rows.schema).alias("row"))
    left = rows.where(known(rows, at)).select(*(rows[k].alias(n) for k, n in zip(keys, names, strict=True)), rows[at].alias("time"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("tie"), F.lit(None).cast(right.schema["event"].dataType).alias("event"), F.struct(*(rows[c] for c in rows.columns)).alias("row"))
    order = ["time", "kind", "event", "tie"]
    placed = staged(right.union(left).repartitionByRange(*names, *order).withColumn("part", F.spark_partition_id()), "as_of")

    upto = Window.partitionBy("part", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumn("found", F.last("event", ignorenulls=True).over(upto)).where("kind = 1")
    latest = F.max(F.when(F.col("kind") == 0, F.struct("time", "event")))
    before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("part", *names).agg(latest.alias("ended")).withColumn("carried", F.last("ended", ignorenulls=True).over(before))
    carried = ends.where("carried is not null").select("part", *names, F.col("carried.event").alias("carried"))  # a row for each range at most
    joined = here.join(F.broadcast(carried), ["part", *names], "left").select("row", "time", F.coalesce("found", "carried").alias("found"))
    if within is not None:
        joined = joined.withColumn("found", F.when(F.col(f"found.{prefix}{event_at}") + within >= F.col("time"), F.col("found")))
    out = joined.select("row.*", *(F.col(f"found.{prefix}{c}") for c in others))
    return out.union(rows.where(~known(rows, at)).select("*", *(nothing[prefix + c].alias(prefix + c) for c in others)))
