"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_homes: dict[tuple[str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set a local session gets a temporary one; on a cluster its executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    key = spark.sparkContext.applicationId, shared_root(spark)
    home = _homes.setdefault(key, f"{key[1]}/quillon-{uuid.uuid4().hex}")
    return f"{home}/{uuid.uuid4().hex}/{name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end; what reads them must have been written elsewhere by then."""
    key = spark.sparkContext.applicationId, shared_root(spark)
    before = _homes.get(key)
    _homes[key] = home = f"{key[1]}/quillon-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        if before is None:
            _homes.pop(key, None)
        else:
            _homes[key] = before
        remove(spark, home)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; results that read them must have been written before."""
    for key in [k for k in _homes if k[0] == spark.sparkContext.applicationId]:
        remove(spark, _homes.pop(key))
