"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

Held = TypeVar("Held")

#: Sizes beyond this are Spark's way to say that it does not know.
UNKNOWN = 1 << 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def input_bytes(df: DataFrame) -> int:
    """Size of the files below a plan, as the optimizer knows it; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def parts_for(df: DataFrame, target_mb: float, least: int = 12) -> int:
    """A number of partitions that leaves about target_mb of df's input to each, whatever the input's size. Where Spark
    does not know the size, as for rows from Python, df's own number of partitions is kept."""
    size = input_bytes(df)
    return max(least, math.ceil(size / (target_mb * 1e6)) if size < UNKNOWN else df.rdd.getNumPartitions())


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a session on a single
    machine (master local), as in tests, gets a temporary folder; any other is refused, as its executors share none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    if "://" not in base:
        base = base.replace("file:", "file://") if base.startswith("file:") else f"file://{base}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context; a no-op for jobs that stay in the JVM."""
    sc = spark.sparkContext
    if getattr(sc, "_charlspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / "charlspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"charlspark/{p.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._charlspark_shipped = True


_held: dict[str, object] = {}


def only(name: str, make: Callable[[], Held]) -> Held:
    """make()'s result, kept in this Python worker under name until a task asks for another one: Spark reuses workers, and
    what one step remembers must not take room from the next."""
    if name not in _held:
        tidy()
        _held[name] = make()
    return _held[name]


def tidy() -> None:
    """Forgets what the worker holds and gives free memory back to the machine."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
