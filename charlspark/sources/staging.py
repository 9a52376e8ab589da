"""Tables between steps, in the folder that the cluster shares (spark.checkpoint.dir), so that lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that any executor can hold.
MOST = 200_000


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder. Where none is set, a session on one machine (master local) gets a temporary folder;
    any other is refused."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="staging-")
        sc.setCheckpointDir(base)
    if base.startswith("file:") and "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/') if '://' in base else 'file://' + base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def slim_rows(spark: SparkSession) -> Iterator[None]:
    """For steps that are carried out here and send slim rows to Python: batches end by their number of rows alone. Otherwise Spark adds up the
    bytes of a batch after each row, which takes longer than all else that it does with a short one. The session is as before afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(2**31 - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df, written in buckets of key and read again: what groups or joins by key needs no exchange. The table's name is gone
    when this returns; the files stay as long as the shared folder does."""
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def for_all(df: DataFrame) -> DataFrame:
    """df, written once and to be broadcast if it has at most MOST rows; joined in the ordinary way if not."""
    out = staged(df)
    return F.broadcast(out) if out.count() <= MOST else out
