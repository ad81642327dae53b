"""Rounding by the exact binary value, ties to even, on aggregated rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def exact_round(value: Column, places: int) -> Column:
    """Spark rounds the shortest decimal of a double; results were published rounded by its exact value."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if pd.isna(x) else round(float(x), places))

    return rounded(value.cast("double"))


def exact_format(value: Column, places: int) -> Column:
    """Fixed decimals of the exactly rounded value."""

    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else f"{float(x):.{places}f}")

    return written(value.cast("double"))
