"""Intermediate tables in the folder that the whole cluster shares.

``materialize`` cuts lineage by writing Parquet into the folder named by ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs only the stage in flight. A local folder serves only where that setting is absent and Spark runs on this machine alone.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = os.environ.get("LEKTOR_LOCAL_SHARED") or os.environ.setdefault("LEKTOR_LOCAL_SHARED", tempfile.mkdtemp(prefix="lektor-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lektor/{label}-{uuid.uuid4().hex}"
    _LIVE.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the intermediate tables written so far (all but the first ``keep``). Call only when their readers are done."""
    while len(_LIVE) > keep:
        _, path = _LIVE.pop()
        drop_path(spark, path)


def mark() -> int:
    return len(_LIVE)


def take(since: int) -> list[str]:
    """Paths of the tables written since ``mark``; the caller now sees to their removal."""
    out = [path for _, path in _LIVE[since:]]
    del _LIVE[since:]
    return out


@atexit.register
def _at_exit() -> None:
    for spark, path in _LIVE:
        try:
            if spark._jsc.sc().isStopped():
                raise RuntimeError
            drop_path(spark, path)
        except Exception:  # the session is gone; local folders can still be removed
            import shutil

            local = path.removeprefix("file://")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, from the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
