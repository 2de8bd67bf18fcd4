"""What the operators share: scratch tables, small Arrow batches, broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import scratch as folder

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
remove = folder.remove


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: where the session has Spark's default number of rows in an Arrow batch, this lowers it, so that batches stay a few MB."""
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, "1000")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    small_batches(spark)
    return folder.scratch(spark, name)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    small_batches(df.sparkSession)
    return folder.table(df, name)


def free(df: DataFrame, name: str) -> str:
    """A column name like that one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts df (a written, narrow table) only if it has at most that many rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
