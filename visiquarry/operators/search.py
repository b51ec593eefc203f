"""Search performance: pages that compete for one query, and top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .findings import estimate_impact, finding
from .keys import KEYS, round_half_up, top

SECONDARY_SHARE = 0.2
ROWS_LIMIT = 30


def cannibalization(rows: DataFrame, share: float = SECONDARY_SHARE, seq: str = "page") -> DataFrame:
    """One row per query with two pages or more, where another page has ``share`` of the first one's impressions or more."""
    order = Window.partitionBy(*KEYS, "query").orderBy(F.desc("impressions"), F.asc(seq))
    placed = rows.where("page <> ''").withColumns({"place": F.row_number().over(order), "primary": F.first("page").over(order), "most": F.first("impressions").over(order)})
    second = placed.where("place > 1").withColumn("share", F.try_divide(F.col("impressions").cast("double"), F.col("most"))).where(F.col("share") >= share)
    out = second.groupBy(*KEYS, "query", "primary", F.col("most").alias("primary_impressions")).agg(F.count(F.lit(1)).alias("n_secondary"), F.max("share").alias("top_share"), F.array_join(F.array_sort(F.collect_list("page")), ",").alias("secondary_pages"))
    return out.withColumns({"severity": F.lit("high"), "impact": estimate_impact(F.lit("high"), F.col("top_share")), "top_percent": round_half_up(F.col("top_share") * 100)})


def cannibalization_findings(rows: DataFrame, share: float = SECONDARY_SHARE, seq: str = "page") -> DataFrame:
    """Every query of ``cannibalization`` as a finding about its first page."""
    evidence = F.concat_ws(" ", "primary", "primary_impressions", "secondary_pages")
    one = finding("cannibalization", "content", "high", F.col("primary"), evidence, F.col("top_share"), detail=F.col("query"))
    return cannibalization(rows, share, seq).select(*KEYS, one.alias("f")).select(*KEYS, "f.*")


def top_rows(rows: DataFrame, n: int = ROWS_LIMIT) -> DataFrame:
    """The rows with most impressions of each run."""
    return top(rows, n, [*KEYS], [F.desc("impressions"), F.asc("query"), F.asc("page")])
