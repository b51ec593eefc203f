"""Runs: natural keys, run states, the latest runs, retention. Snapshots of their rows are in ``snapshots``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import KEYS

RETENTION = 90

# Natural keys of the fact tables, beside client and run.
NATURAL_KEYS = {
    "keyword_snapshots": ("keyword",), "serp_results": ("keyword", "position"), "backlinks": ("domain",), "tech_audits": ("url",),
    "ai_visibility_samples": ("query", "model", "sample_index"), "gsc_metrics": ("query", "page"), "competitors": ("domain",),
    "keyword_gaps": ("keyword", "competitor_domain"), "index_status": ("url",), "field_cwv": ("url", "form_factor"), "pages": ("url",),
    "page_links": ("source_url", "target_url"), "sitemap_urls": ("url",),
}


def first_rows(rows: DataFrame, table: str, seq: str = "seq") -> DataFrame:
    """The first row, by ``seq`` (not null), of every natural key, for sources that repeat themselves (a link in header and footer,
    a field record, a keyword gap). An aggregate, so repeats meet within tasks before the shuffle."""
    keys = [*KEYS, *NATURAL_KEYS[table]]
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.min_by(rest, seq).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def run_states(events: DataFrame) -> DataFrame:
    """The state of every run from its events (client, run_id, status, config_hash, ts); only a running run can be closed."""
    closed = F.min_by("status", F.when(F.col("status") != "running", F.col("ts")))
    return events.groupBy(*KEYS).agg(F.coalesce(closed, F.lit("running")).alias("status"), F.first("config_hash", True).alias("config_hash"), F.min("ts").alias("started_at"), F.min(F.when(F.col("status") != "running", F.col("ts"))).alias("finished_at"))


def latest(runs: DataFrame) -> DataFrame:
    """client, latest_run, its status, latest_completed_run and the completed run before that."""
    done = F.when(F.col("status") == "completed", F.col("run_id"))
    out = runs.groupBy("client").agg(F.max("run_id").alias("latest_run"), F.max_by("status", "run_id").alias("latest_status"), F.max(done).alias("latest_completed_run"))
    before = runs.where("status = 'completed'").join(out.select("client", "latest_completed_run"), "client").where("run_id < latest_completed_run").groupBy("client").agg(F.max("run_id").alias("previous_completed_run"))
    return out.join(before, "client", "left")


def previous_completed(runs: DataFrame) -> DataFrame:
    """Every run with the newest completed run before it."""
    done = F.when(F.col("status") == "completed", F.col("run_id"))
    before = Window.partitionBy("client").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("previous_run", F.max(done).over(before))


def kept_runs(runs: DataFrame, n: int = RETENTION) -> DataFrame:
    """The newest ``n`` runs of each client, whatever their state."""
    order = Window.partitionBy("client").orderBy(F.desc("run_id"))
    return runs.select(*KEYS).distinct().withColumn("age", F.row_number().over(order)).where(F.col("age") <= n).drop("age")


def prune(rows: DataFrame, runs: DataFrame, n: int = RETENTION) -> DataFrame:
    """Rows of the runs kept."""
    return rows.join(kept_runs(runs, n), [*KEYS], "left_semi")


def config_hash(configs: DataFrame) -> DataFrame:
    """configs with config_hash: twelve hex digits over the domain and the sorted lists."""
    lists = [F.sort_array(c).alias(c) for c in ("seed_keywords", "seed_competitors", "ai_queries")]
    return configs.withColumn("config_hash", F.left(F.sha2(F.to_json(F.struct("domain", *lists)), 256), F.lit(12)))


def client_status(clients: DataFrame, runs: DataFrame) -> DataFrame:
    """Every client with its latest run; null where it has none."""
    return clients.select("client").distinct().join(latest(runs), "client", "left")


def failed_clients(status: DataFrame) -> DataFrame:
    return status.where("latest_status = 'failed'")
