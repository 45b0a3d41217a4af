"""Documents that arrive in versions, late and repeatedly: the latest one wins, and counters follow it."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clausewright.operators import claims as C
from clausewright.operators.normalize import normalize

OUT = "doc_id string, kind string, version timestamp, claim_count long, claims_delta long, seen long, passed long"
_STATE = "version long, claim_count long, seen long, passed long"  # versions are microseconds here
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGED, SETTLED = "changed", "settled"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it streams start with the state store on disk that versions() needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class LatestVersion(StatefulProcessor):
    """Holds of each document its latest version's time and claim count and how many versions were seen and passed over. Its rows
    are gone through one by one, so that a document may have any number of them."""

    def __init__(self, quiet: datetime.timedelta):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _due(self, version: int) -> int:
        return version // 1000 + self.quiet // datetime.timedelta(milliseconds=1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        version, count, seen, passed = tuple(held) if held else (None, 0, 0, 0)
        was, old = version, count
        for row in rows:
            seen += 1
            if version is not None and row.version <= version:
                passed += 1  # late, repeated, or overtaken by what came with it
                continue
            passed += version is not None and version != was  # overtaken before it was told
            version, count = row.version, row.claim_count
        self.last.update((version, count, seen, passed))
        if version != was:
            if was is not None:
                self.handle.deleteTimer(self._due(was))
            self.handle.registerTimer(self._due(version))
            yield Row(doc_id=key[0], kind=CHANGED, version=version, claim_count=count, claims_delta=count - old, seen=seen, passed=passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.last.exists():
            version, count, seen, passed = tuple(self.last.get())
            self.last.clear()
            yield Row(doc_id=key[0], kind=SETTLED, version=version, claim_count=count, claims_delta=0, seen=seen, passed=passed)

    def close(self) -> None:
        pass


def versions(docs: DataFrame, late: str = "1 hour", quiet: datetime.timedelta = datetime.timedelta(days=1)) -> DataFrame:
    """A stream of ``docs`` (doc_id, text, ts: the version's time) to a stream of changes: doc_id, kind, version, claim_count, claims_delta (to
    the version before, so that their sum is the claims of all latest versions), seen and passed (versions so far, and those that were never the latest).

    A batch's newest version of a document is ``changed`` if it is newer than all before; older and repeated ones are counted alone. When the
    watermark (``late`` behind the newest time) has passed a document's version by ``quiet``, it is ``settled`` and its state goes, so that
    what is held follows the documents of that time. Rows without a doc_id or ts are left out. Start it within state_store().
    """
    counted = normalize(docs.where("doc_id is not null and ts is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), "text"))
    counted = counted.select("doc_id", "ts", F.unix_micros("ts").alias("version"), F.size(C.raw_claims(C.claims_section(F.col("text")))).cast("long").alias("claim_count"))
    grouped = counted.withWatermark("ts", late).groupBy("doc_id")
    changes = grouped.transformWithState(LatestVersion(quiet), OUT.replace("version timestamp", "version long"), "Append", "EventTime")
    return changes.withColumn("version", F.timestamp_micros("version"))


def sessions(docs: DataFrame, by: str = "source", at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents, characters and claims by sessions of a source: arrivals that follow each other within ``gap``."""
    counted = normalize(docs.withColumn(at, F.col(at).cast("timestamp"))).withColumn("claim_count", F.size(C.raw_claims(C.claims_section(F.col("text")))))
    grouped = counted.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("session"))
    totals = grouped.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum("claim_count").alias("claims"))
    return totals.select(by, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "documents", "chars", "claims")
