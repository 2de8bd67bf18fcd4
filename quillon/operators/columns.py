"""Analytic types of columns: numeric if any cell is a number, else categorical."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numbers import label, number, quoted


@dataclass(frozen=True)
class Typed:
    """A data set with its columns sorted by type, in file order. rows and present (non-null cells) are exact."""

    df: DataFrame
    numeric: list[str]
    categorical: list[str]
    unsupported: list[str]
    rows: int
    present: dict[str, int]
    numbers: dict[str, int]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.unsupported]

    def x(self, name: str) -> Column:
        return number(quoted(name), self.df.schema[name].dataType)

    def k(self, name: str) -> Column:
        return label(quoted(name), self.df.schema[name].dataType)

    def ord(self, name: str) -> int:
        return self.df.columns.index(name)

    def wide(self) -> DataFrame:
        """Numeric columns as x0, x1, ... and categorical ones as k0, k1, ...: names that need no quoting."""
        return self.df.select(*(self.x(c).alias(f"x{i}") for i, c in enumerate(self.numeric)), *(self.k(c).alias(f"k{i}") for i, c in enumerate(self.categorical)))


def classify(df: DataFrame, dynamic: bool = False) -> Typed:
    """One scan. dynamic: texts may be numbers, as in a CSV file; a typed source's texts are texts."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    unsupported = [f.name for f in df.schema.fields if isinstance(f.dataType, nested)]
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in unsupported}
    maybe = [c for c, k in kinds.items() if isinstance(k, T.NumericType) or dynamic and isinstance(k, T.StringType)]
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(quoted(c)).alias(f"present{i}") for i, c in enumerate(kinds)),
        *(F.count(number(quoted(c), kinds[c])).alias(f"numbers{i}") for i, c in enumerate(maybe)),
    ).first()
    numbers = {c: counts[f"numbers{i}"] for i, c in enumerate(maybe)}
    numeric = [c for c in kinds if numbers.get(c)]
    return Typed(df, numeric, [c for c in kinds if c not in numeric], unsupported, counts["rows"], {c: counts[f"present{i}"] for i, c in enumerate(kinds)}, numbers)


def column_types(typed: Typed) -> DataFrame:
    spark = typed.df.sparkSession
    kind = lambda c: "numeric" if c in typed.numeric else "categorical" if c in typed.categorical else "unsupported"
    return spark.createDataFrame([(i, c, kind(c)) for i, c in enumerate(typed.df.columns)], "ord int, column string, type string")
