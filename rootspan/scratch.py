"""Lineage cuts: tables written to the folder that the whole cluster shares.

``settle`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back. Against
``checkpoint()`` this keeps columns compressed and prunable, and the planner knows the size of the
files, so that a join with the result is broadcast only below ``autoBroadcastJoinThreshold``. Executors
can be lost at any time: the files are not on their disks.

Every table belongs to a scope, a setting of the calling thread. ``release`` deletes the tables of a scope
once nothing reads them; what is left when the application ends goes then.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, list[str]] = defaultdict(list)
_scope: ContextVar[str] = ContextVar("scope", default="default")
_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the setting is absent."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rootspan-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table, remembered under the current scope."""
    own = f"{shared_dir(spark)}/rootspan-{spark.sparkContext.applicationId}"
    if own not in _leaving:
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
        _leaving.add(own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    _written[_scope.get()].append(path)
    return path


def settle(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """``settle`` and the number of rows, counted while they are written."""
    seen = Observation()
    out = settle(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def enter(scope: str) -> None:
    """Put the tables that this thread settles from now on into ``scope``."""
    _scope.set(scope)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete one settled table at once: for steps of a loop that the next step has replaced."""
    for file in df.inputFiles()[:1]:
        path = file.rsplit("/", 1)[0]
        drop_path(df.sparkSession, path)


def release(spark: SparkSession, scope: str) -> None:
    """Delete what ``scope`` has written. Only for results that are stored elsewhere by now."""
    for path in _written.pop(scope, []):
        drop_path(spark, path)
