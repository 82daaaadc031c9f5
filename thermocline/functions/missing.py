"""NaN becomes NULL once, on ingest; every operator relies on NULL as the only missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def without_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def require_columns(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
