"""Documents as a stream: the row-local part of the path unchanged, and counters by window of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators import claims as C
from clausewright.operators.normalize import normalize


def stream_claims(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Parsed claims of a stream of documents; stateless, so it needs no watermark and keeps no state."""
    return C.parse_claims(normalize(docs), keys)


def arrivals(docs: DataFrame, at: str = "ts", late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Documents, characters and claims by tumbling window, or by one that slides; rows later than the watermark are left out."""
    counted = normalize(docs).withColumn("claim_count", F.size(C.raw_claims(C.claims_section(F.col("text")))))
    by = counted.withWatermark(at, late).groupBy(F.window(at, length, slide))
    return by.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum("claim_count").alias("claims")).select(F.col("window.start").alias("window_start"), "documents", "chars", "claims")
