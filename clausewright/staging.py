"""Written tables that cut a plan's lineage.

They go to a folder of the application below ``spark.checkpoint.dir``, which all executors share and which outlives them. Where that
setting is absent a temporary folder serves if driver and executors are one process (tests, a single machine); on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # the temporary folder of an application
_told: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="clausewright-")
        found = _own[context.applicationId]
    return f"{found.rstrip('/')}/tables-{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has staged. Results that weren't written by then can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped
        clear(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has yet. What is there is deleted by clear(), or when the driver's program ends."""
    if spark.sparkContext.applicationId not in _told:
        _told.add(spark.sparkContext.applicationId)
        atexit.register(_clear_at_exit, spark)
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, rows_of_file: int = 0) -> DataFrame:
    """Writes ``df`` once and returns the written table. ``rows_of_file`` bounds the rows of a file (0: no bound), for rows so wide
    that a reader should hold few of them."""
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_of_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
