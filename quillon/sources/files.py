"""Reading and writing data sets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numbers import quoted
from quillon.sources import csv_records
from quillon.sources.scratch import table

CORRUPT = "_malformed"


def not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no data found")
    return df


_FORMAT = {"header": True, "escape": '"', "mode": "PERMISSIVE"}


def _cells(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """Every cell as text; corrupt: see `csv_records.parsed`. Files of more than one split are read in parallel; if cells hold newlines they are
    written as a table, so that what follows, often several scans, doesn't join lines again. With corrupt the result is a table, too, of at least the rows that have it."""
    whole = spark.read.options(**_FORMAT, multiLine=True)
    header = whole.csv(path).schema
    if not header.names:
        return spark.createDataFrame([], T.StructType([T.StructField(corrupt, T.StringType())] if corrupt else []))
    sizes = spark.read.format("binaryFile").load(path).agg(F.max("length"), F.sum("length"), F.count(F.lit(1))).first()  # from the listing of the files
    known = None
    if sizes[0] > csv_records.split_bytes(spark, sizes[1], sizes[2]):
        lines = csv_records.lines(spark, path)
        known = csv_records.layout(lines)
        if known.special and not known.unsplit:
            return table(csv_records.parsed(csv_records.records(lines, known), header.names, corrupt), "csv_cells")  # its splits are those of now
    reader = whole if known is None or known.special or known.unsplit else spark.read.options(**_FORMAT)
    if corrupt:
        rows = reader.options(columnNameOfCorruptRecord=corrupt, enforceSchema=True).schema(T.StructType([*header, T.StructField(corrupt, T.StringType())])).csv(path)
        return table(rows.where(F.col(corrupt).isNotNull()), "csv_malformed")  # Spark finds them only where it reads all cells, and whoever gets them may ask for fewer
    return reader.csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a folder of them, with a header, every cell as text: types are found per cell, not per column.

    Short rows are filled with nulls, extra cells dropped, blank lines skipped, empty cells null.
    """
    df = _cells(spark, path)
    if not df.columns:
        raise ValueError("no data found")
    return not_empty(df.select([F.nullif(quoted(c), F.lit("")).alias(c) for c in df.columns]))


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, cells) of each line whose cells don't match the header: the line itself and what was read from it."""
    rows = _cells(spark, path, CORRUPT)
    cells = F.struct(*(quoted(c) for c in rows.columns if c != CORRUPT))
    return rows.select(F.col(CORRUPT).alias("row"), cells.alias("cells")).where(F.col("row").isNotNull())


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return not_empty(spark.read.parquet(path))


def export_name(name: str, ending: str = "_export.csv") -> str:
    """File name of an export: the first .csv or .json goes, in either case."""
    return re.sub(r"\.csv|\.json", "", name, count=1, flags=re.I) + ending


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, quoted so that read_csv() gets the same cells back."""
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="").csv(path)


def export_csv(df: DataFrame, folder: str, name: str) -> str:
    """One CSV file in folder, named after the data set by `export_name`; returns its path. One task writes it, row by row as the others' rows arrive, since file systems take a file from one writer;
    `write_csv` is for what should stay in parts. It replaces a file of that name only when it is whole."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts, target = path(f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"), path(f"{folder.rstrip('/')}/{export_name(name)}")
    write_csv(df.repartition(1), parts.toString())
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        written = next(f.getPath() for f in system.listStatus(parts) if f.getPath().getName().startswith("part-"))  # also of no rows there is one, with the header
        system.delete(target, False)
        if not system.rename(written, target):
            raise OSError(f"can't write {target.toString()}")
    finally:
        system.delete(parts, True)
    return target.toString()
