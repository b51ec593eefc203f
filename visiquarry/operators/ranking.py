"""Places of rows in a total order within groups of any size.

A window numbers a group in one task. ``place_all`` deals the rows out by ranges of (group, order) instead, numbers them within
their range, and adds what the ranges before hold of the group: a table of one row for each range and group. For the first few rows
of a group ``keys.top`` is enough, as Spark keeps only that many rows of each group in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_ROW = (1 << 33) - 1


def place_all(rows: DataFrame, by: list[str], order: list[Column | str], place: str = "place") -> DataFrame:
    """``rows`` with ``place``, from 1 within ``by`` in the order given; of rows equal in all of it any may come first.

    The ranges are written to the shared folder, so that numbers once given stay. Null groups are groups.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    numbered = stored(dealt, "ranges").withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(_ROW)})
    held = numbered.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"_k{i}" for i in range(len(by))]
    shift = held.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col("_range").alias("_r"), (1 - F.col("_first") + F.coalesce(before, F.lit(0))).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    placed = numbered.join(shift, same).withColumn(place, (F.col("_row") + F.col("_shift")).cast("int"))
    return placed.select(*[c for c in rows.columns if c != place], place)
