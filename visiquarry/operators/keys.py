"""Keys that every table carries: one site and one run of its analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("client", "run_id")


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, n: int, by: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group, numbered."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)
