"""What changed between a run and the completed run before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ai import client_rate
from .findings import finding_key
from .runs import previous_completed

UNRANKED, RANK_DROP, LCP_WORSE, AI_DROP = 11, 3, 500, 0.34


def _alert(severity: Column, kind: str, subject: Column) -> list[Column]:
    return [severity.alias("severity"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject")]


def rank_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """client, keyword, previous_rank, current_rank, delta for keywords whose rank differs; no rank counts as 11."""
    a = previous.select("client", "keyword", F.col("client_rank").alias("previous_rank"))
    b = current.select("client", "keyword", F.col("client_rank").alias("current_rank"))
    both = a.join(b, ["client", "keyword"], "full_outer").where(~F.col("previous_rank").eqNullSafe(F.col("current_rank")))
    return both.withColumn("delta", F.coalesce("previous_rank", F.lit(UNRANKED)) - F.coalesce("current_rank", F.lit(UNRANKED)))


def rank_alerts(changes: DataFrame) -> DataFrame:
    """Left the first ten: warning; entered them: info; fell by three places or more: warning."""
    left = F.col("previous_rank").isNotNull() & F.col("current_rank").isNull()
    came = F.col("previous_rank").isNull() & F.col("current_rank").isNotNull()
    kind = F.when(left, "rank_lost").when(came, "rank_gained").when(-F.col("delta") >= RANK_DROP, "rank_drop")
    out = changes.withColumn("kind", kind).where("kind is not null")
    return out.select("client", F.when(F.col("kind") == "rank_gained", "info").otherwise("warning").alias("severity"), "kind", F.col("keyword").cast("string").alias("subject"))


def entries_and_exits(previous: DataFrame, current: DataFrame) -> DataFrame:
    """client, domain, change (entry or exit) of real competitors."""
    a, b = (x.select("client", "domain").distinct() for x in (previous, current))
    return b.join(a, ["client", "domain"], "left_anti").withColumn("change", F.lit("entry")).unionByName(a.join(b, ["client", "domain"], "left_anti").withColumn("change", F.lit("exit")))


def cwv_deltas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Differences of the vitals of URLs that both runs audited."""
    old = previous.select("client", "url", *(F.col(c).alias(f"old_{c}") for c in ("lcp_ms", "inp_ms", "cls")))
    both = current.join(old, ["client", "url"])
    return both.select("client", "url", (F.col("lcp_ms") - F.col("old_lcp_ms")).alias("lcp_delta_ms"), (F.col("inp_ms") - F.col("old_inp_ms")).alias("inp_delta_ms"), (F.col("cls") - F.col("old_cls")).alias("cls_delta"))


def ai_rate_deltas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Queries of both runs whose mention rate differs."""
    a = client_rate(previous).select("client", "query", F.col("client_rate").alias("previous_rate"))
    b = client_rate(current).select("client", "query", F.col("client_rate").alias("current_rate"))
    return a.join(b, ["client", "query"]).where("previous_rate <> current_rate")


def findings_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Findings of one run alone, with ``change`` new or resolved; repeated ones stay repeated."""
    key = finding_key(F.col("category"), F.col("title"), F.col("url"))
    a, b = previous.withColumn("key", key), current.withColumn("key", key)
    new = b.join(a.select("client", "key").distinct(), ["client", "key"], "left_anti").withColumn("change", F.lit("new"))
    gone = a.join(b.select("client", "key").distinct(), ["client", "key"], "left_anti").withColumn("change", F.lit("resolved"))
    return new.unionByName(gone)


def page_count_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    counted = previous.select("client", F.lit(-1).alias("n")).unionByName(current.select("client", F.lit(1).alias("n")))
    return counted.groupBy("client").agg(F.sum("n").alias("page_count_delta"))


def config_mismatch(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Runs whose configuration differs from the one before."""
    a = previous.select("client", F.col("config_hash").alias("old"))
    return current.join(a, "client").where("config_hash <> old").select("client", *_alert(F.lit("info"), "config_changed", F.col("client")))


def baselines(runs: DataFrame) -> DataFrame:
    """Every run with previous_run, is_baseline (no completed run before it, so nothing to compare) and config_mismatch.
    runs: client, run_id, status, config_hash."""
    placed = previous_completed(runs)
    before = runs.select("client", F.col("run_id").alias("previous_run"), F.col("config_hash").alias("_before"))
    out = placed.join(before, ["client", "previous_run"], "left")
    mismatch = F.col("previous_run").isNotNull() & ~F.col("config_hash").eqNullSafe(F.col("_before"))
    return out.withColumns({"is_baseline": F.col("previous_run").isNull(), "config_mismatch": mismatch}).drop("_before")


def alerts(ranks: DataFrame, competitors: DataFrame, vitals: DataFrame, ai: DataFrame) -> DataFrame:
    """All alerts of a comparison: client, severity, kind, subject."""
    entered = competitors.where("change = 'entry'").select("client", *_alert(F.lit("info"), "competitor_entry", F.col("domain")))
    slower = vitals.where(F.col("lcp_delta_ms") > LCP_WORSE).select("client", *_alert(F.lit("warning"), "lcp_regression", F.col("url")))
    quieter = ai.where(F.col("previous_rate") - F.col("current_rate") >= AI_DROP).select("client", *_alert(F.lit("warning"), "ai_rate_drop", F.col("query")))
    return rank_alerts(ranks).unionByName(entered).unionByName(slower).unionByName(quieter)
