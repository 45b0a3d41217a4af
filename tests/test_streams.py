"""Streams of versions, windows that slide, and sessions."""

import datetime

from pyspark.sql import functions as F

from clausewright.streaming import claims as T
from clausewright.streaming import versions as V

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def document(doc, hours, claims):
    return doc, "\n".join(f"{k}. A lens." for k in range(1, claims + 1)), int((START + datetime.timedelta(hours=hours)).timestamp() * 1_000_000)


def test_the_latest_version_wins_and_goes_when_it_is_quiet(spark, tmp_path):
    def arrive(*rows):
        frame = spark.createDataFrame(list(rows), "doc_id string, text string, us long").select("doc_id", "text", F.timestamp_micros("us").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with V.state_store(spark):
            stream = V.versions(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "1 hour", datetime.timedelta(days=1))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(V.OUT).parquet(str(tmp_path / "out")).select("doc_id", "kind", ((F.unix_micros("version") - int(START.timestamp() * 1_000_000)) / 3_600_000_000).alias("at"), "claim_count", "claims_delta", "seen", "passed")
        return sorted(tuple(r) for r in out.collect())

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first = [("a", "changed", 1.0, 3, 3, 3, 2), ("b", "changed", 0.0, 2, 2, 1, 0)]
    # of one batch the newest, whatever the order; a repeated version counts once
    assert arrive(document("a", 0, 1), document("a", 1, 3), document("a", 1, 3), document("b", 0, 2), (None, "1. A.", 0)) == first
    # a late version is counted and changes nothing; a newer one tells the difference
    second = sorted([*first, ("b", "changed", 2.0, 1, -1, 2, 0)])
    assert arrive(document("a", 0.5, 9), document("b", 2, 1)) == second
    # the watermark passes both by more than a day
    third = sorted([*second, ("a", "settled", 1.0, 3, 0, 4, 3), ("b", "settled", 2.0, 1, 0, 2, 0), ("c", "changed", 100.0, 1, 1, 1, 0)])
    assert arrive(document("c", 100, 1)) == third
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_sessions_and_sliding_windows(spark):
    rows = [("x", 0), ("x", 0.3), ("x", 1.2), ("y", 0.1), ("x", 1.5), ("y", None)]
    docs = spark.createDataFrame([(s, None if h is None else document("d", h, 2)[2], document("d", 0, 2)[1]) for s, h in rows], "source string, us long, text string").select("source", "text", F.timestamp_micros("us").alias("ts"))
    got = {(r.source, r.documents, r.claims, (r.session_end - r.session_start).total_seconds() / 60) for r in V.sessions(docs).collect()}
    assert got == {("x", 2, 4, 48.0), ("x", 2, 4, 48.0), ("y", 1, 2, 30.0)}
    tumbling, sliding = (T.arrivals(docs, length="1 hour", slide=slide).agg(F.sum("documents"), F.count("*")).first() for slide in (None, "30 minutes"))
    assert tumbling[0] == 5 and sliding[0] == 10 and sliding[1] > tumbling[1]
