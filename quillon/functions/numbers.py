"""Column expressions for numbers, and the number formats of reports."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a text cell must look like to be a number; wider casts (suffixes, NaN, a leading plus) don't count.
NUMBER = r"^\s*-?(\d+\.?|\.\d+|\d+\.\d+)([eE][-+]?\d+)?\s*$"
#: Larger integers can't be told apart as doubles and stay text.
EXACT = 2.0**53


def number(column: Column, kind: T.DataType) -> Column:
    """The cell as a double, null if it is no finite number."""
    if isinstance(kind, T.StringType):
        value = F.when(column.rlike(NUMBER), F.trim(column).try_cast("double"))
        return F.when(F.abs(value) < EXACT, value)
    if isinstance(kind, T.NumericType):
        value = column.cast("double")
        return F.when(F.abs(value) < float("inf"), value)  # NaN is above all
    return F.lit(None).cast("double")


#: As many digits as any double has, before the point and after.
_DIGITS = Context(prec=400)


def quoted(name: str) -> Column:
    """A column by its name, whatever it is made of."""
    return F.col("`" + name.replace("`", "``") + "`")


def label(column: Column, kind: T.DataType) -> Column:
    """The cell as a category: text as it is, Booleans in lower case."""
    if isinstance(kind, T.StringType):
        return F.when(column.isin("TRUE", "FALSE"), F.lower(column)).otherwise(column)
    return column.cast("string")


def variation(std: Column, mean: Column) -> Column:
    """Coefficient of variation in percent; null where the mean is 0."""
    return F.try_divide(std, mean) * 100


def at_floor(value: str, share: float, n: int) -> Column:
    """The element at index floor(n * share) of the sorted values, which number n."""
    return F.expr(f"percentile_disc({(int(n * share) + 0.5) / n}) WITHIN GROUP (ORDER BY {value})") if n else F.lit(None).cast("double")


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over rows that have both; 0 where it isn't defined."""
    x2, y2 = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.coalesce(F.try_divide(F.covar_pop(x2, y2), F.stddev_pop(x2) * F.stddev_pop(y2)), F.lit(0.0))


def fixed(value: float | None, places: int) -> str:
    """The value with that many decimals; ties of its exact binary value go away from 0."""
    if value is None:
        return "N/A"
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP, context=_DIGITS))


def plain(value: float) -> str:
    """A number as a label: no decimals if it is whole."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))
