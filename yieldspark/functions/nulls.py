"""One missing marker: NULL. NaN and infinities become NULL where data enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """The number, or NULL if it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float column with NaN as NULL; infinities stay."""
    own = {f.name: F.nanvl(df[f.name], F.lit(None).cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(own) if own else df


def to_number(c: Column) -> Column:
    """Text to a finite double; what does not parse is NULL."""
    return finite(c.try_cast("double"))
