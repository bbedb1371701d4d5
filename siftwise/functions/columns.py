"""Columns that plans above take as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, as a model's answers are.

    They pass through a generator, which the optimiser neither merges into what reads them nor lets
    filters past, so no condition on one turns into the whole computation of it, once for each mention.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
