"""Comparisons of all runs of all clients at once, over fact tables of five clients and six runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots, trend
from ..operators.keys import KEYS
from ..sources.shared import shared_dir, stored
from . import views
from .registry import ORACLES, query
from .views import with_views

FACTS = ("v_run_keywords", "v_run_competitors", "v_run_audits", "v_run_samples", "v_run_pages", "v_run_findings")


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The runs' states, written once as every kind of change meets them, and the fact tables."""
    with views.held(spark, sf_dir, "v_run_states"):
        return tuple(views.view(spark, sf_dir, v) for v in ("v_run_states", *FACTS))


# the twin joins each run with the one before; p: comparisons
_TREND = with_views("v_run_states", *FACTS) + r""",
p AS (SELECT client, run_id, config_hash, lag(run_id) OVER w AS previous_run, lag(config_hash) OVER w AS previous_hash FROM v_run_states WHERE status = 'completed' WINDOW w AS (PARTITION BY client ORDER BY run_id)),
c AS (SELECT * FROM p WHERE previous_run IS NOT NULL),
ra AS (SELECT c.client, c.run_id, c.previous_run, k.keyword, k.client_rank FROM c JOIN v_run_keywords k ON k.client = c.client AND k.run_id = c.previous_run),
rb AS (SELECT c.client, c.run_id, c.previous_run, k.keyword, k.client_rank FROM c JOIN v_run_keywords k ON k.client = c.client AND k.run_id = c.run_id),
r AS (SELECT client, run_id, previous_run, CAST(keyword AS VARCHAR) AS subject, ra.client_rank AS old, rb.client_rank AS new, coalesce(ra.client_rank, 11) - coalesce(rb.client_rank, 11) AS delta
  FROM ra FULL OUTER JOIN rb USING (client, run_id, previous_run, keyword) WHERE ra.client_rank IS DISTINCT FROM rb.client_rank),
ka AS (SELECT DISTINCT c.client, c.run_id, c.previous_run, k.domain FROM c JOIN v_run_competitors k ON k.client = c.client AND k.run_id = c.previous_run WHERE is_real_competitor),
kb AS (SELECT DISTINCT c.client, c.run_id, c.previous_run, k.domain FROM c JOIN v_run_competitors k ON k.client = c.client AND k.run_id = c.run_id WHERE is_real_competitor),
v AS (SELECT c.client, c.run_id, c.previous_run, a.url, [a.lcp_ms, a.inp_ms, a.cls] AS old, [b.lcp_ms, b.inp_ms, b.cls] AS new
  FROM c JOIN v_run_audits a ON a.client = c.client AND a.run_id = c.previous_run JOIN v_run_audits b ON b.client = c.client AND b.run_id = c.run_id AND b.url = a.url),
ve AS (SELECT client, run_id, previous_run, url, unnest(['lcp', 'inp', 'cls']) AS m, unnest(old) AS old, unnest(new) AS new FROM v),
g AS (SELECT client, run_id, query, avg(CASE WHEN client_mentioned THEN 1 ELSE 0 END) AS rate FROM v_run_samples GROUP BY ALL),
s AS (SELECT c.client, c.run_id, c.previous_run, a.query, a.rate AS old, b.rate AS new FROM c JOIN g a ON a.client = c.client AND a.run_id = c.previous_run JOIN g b ON b.client = c.client AND b.run_id = c.run_id AND b.query = a.query WHERE a.rate <> b.rate),
n AS (SELECT c.client, c.run_id, c.previous_run, (SELECT count(*) FROM v_run_pages x WHERE x.client = c.client AND x.run_id = c.previous_run) AS old, (SELECT count(*) FROM v_run_pages x WHERE x.client = c.client AND x.run_id = c.run_id) AS new FROM c),
f AS (SELECT client, run_id, category || '|' || regexp_replace(title, '\d+([.,]\d+)?', 'N', 'g') || '|' || coalesce(url, '') AS key, count(*) AS n FROM v_run_findings GROUP BY ALL),
fa AS (SELECT c.client, c.run_id, c.previous_run, f.key, f.n FROM c JOIN f ON f.client = c.client AND f.run_id = c.previous_run),
fb AS (SELECT c.client, c.run_id, c.previous_run, f.key, f.n FROM c JOIN f ON f.client = c.client AND f.run_id = c.run_id),
change AS (
  SELECT client, run_id, previous_run, CASE WHEN new IS NULL THEN 'rank_lost' WHEN old IS NULL THEN 'rank_gained' WHEN -delta >= 3 THEN 'rank_drop' ELSE 'rank_change' END AS kind, subject,
    CAST(old AS DOUBLE) AS previous_value, CAST(new AS DOUBLE) AS current_value, CAST(delta AS DOUBLE) AS delta, CASE WHEN new IS NULL THEN 'warning' WHEN old IS NULL THEN 'info' WHEN -delta >= 3 THEN 'warning' END AS severity FROM r
  UNION ALL SELECT client, run_id, previous_run, 'competitor_entry', domain, NULL, NULL, NULL, 'info' FROM kb WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.client = kb.client AND ka.run_id = kb.run_id AND ka.domain = kb.domain)
  UNION ALL SELECT client, run_id, previous_run, 'competitor_exit', domain, NULL, NULL, NULL, NULL FROM ka WHERE NOT EXISTS (SELECT 1 FROM kb WHERE ka.client = kb.client AND ka.run_id = kb.run_id AND ka.domain = kb.domain)
  UNION ALL SELECT client, run_id, previous_run, 'vitals_' || m, url, old, new, new - old, CASE WHEN m = 'lcp' AND new - old > 500 THEN 'warning' END FROM ve
  UNION ALL SELECT client, run_id, previous_run, 'ai_rate', query, old, new, new - old, CASE WHEN old - new >= 0.34 THEN 'warning' END FROM s
  UNION ALL SELECT client, run_id, previous_run, 'page_count', NULL, old, new, new - old, NULL FROM n
  UNION ALL SELECT client, run_id, previous_run, 'config_changed', NULL, NULL, NULL, NULL, 'info' FROM c WHERE config_hash <> previous_hash
  UNION ALL SELECT client, run_id, previous_run, 'finding_new', key, 0, n, n, NULL FROM fb WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.client = fb.client AND fa.run_id = fb.run_id AND fa.key = fb.key)
  UNION ALL SELECT client, run_id, previous_run, 'finding_resolved', key, n, 0, -n, NULL FROM fa WHERE NOT EXISTS (SELECT 1 FROM fb WHERE fa.client = fb.client AND fa.run_id = fb.run_id AND fa.key = fb.key))"""


@query(_TREND + " SELECT client, run_id, previous_run, kind, subject, round(previous_value, 6) AS previous_value, round(current_value, 6) AS current_value, round(delta, 6) AS delta, severity FROM change")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completed run of every client against the completed run before it."""
    return trend.changes(*facts(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("previous_value", "current_value", "delta")})


@query(f"SELECT client, run_id, kind, subject, severity FROM ({ORACLES['run_changes']}) WHERE severity IS NOT NULL")
def run_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.alerts(trend.changes(*facts(spark, sf_dir))).select("client", "run_id", "kind", "subject", "severity")


@query(_TREND + """ SELECT p.client, p.run_id, any_value(p.previous_run) AS previous_run, any_value(p.previous_run) IS NULL AS is_baseline, count(*) FILTER (WHERE kind = 'config_changed') > 0 AS config_mismatch,
  CAST(coalesce(sum(delta) FILTER (WHERE kind = 'page_count'), 0) AS BIGINT) AS page_count_delta, count(*) FILTER (WHERE kind LIKE 'rank%') AS rank_changes, count(*) FILTER (WHERE kind = 'competitor_entry') AS competitor_entries,
  count(*) FILTER (WHERE kind = 'competitor_exit') AS competitor_exits, count(*) FILTER (WHERE kind = 'vitals_lcp') AS vitals_deltas, count(*) FILTER (WHERE kind = 'ai_rate') AS ai_deltas,
  count(*) FILTER (WHERE kind = 'finding_new') AS new_findings, count(*) FILTER (WHERE kind = 'finding_resolved') AS resolved_findings, count(severity) AS alerts
FROM p LEFT JOIN change USING (client, run_id) GROUP BY p.client, p.run_id""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every completed run; the first of a client is a baseline without changes."""
    given = facts(spark, sf_dir)
    return trend.summary(given[0], trend.changes(*given))


_KEYWORDS = with_views("v_run_states", "v_run_keywords")
_AGE = " (SELECT client, run_id, dense_rank() OVER (PARTITION BY client ORDER BY run_id DESC) AS age FROM (SELECT DISTINCT client, run_id FROM v_run_states))"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Keyword rows in two commits, the first told twice, and then the newest four runs of each client kept."""
    root = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    states, rows = (views.view(spark, sf_dir, v) for v in ("v_run_states", "v_run_keywords"))
    for name, part in (("first", "run_id <= 3"), ("first", "run_id <= 3"), ("second", "run_id > 3")):
        snapshots.commit(rows.where(part), root, "keyword_snapshots", name)
    snapshots.retire(states, root, "keyword_snapshots", "retention", 4)
    return root


@query(_KEYWORDS + ", a AS" + _AGE + " SELECT client, run_id, CAST(keyword AS BIGINT) AS keyword, client_rank FROM v_run_keywords JOIN a USING (client, run_id) WHERE age <= 4")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.read(spark, _stored(spark, sf_dir), "keyword_snapshots").select(*KEYS, "keyword", "client_rank")


@query(_KEYWORDS + ", a AS" + _AGE + """, n AS (SELECT client, run_id, count(*) AS n_rows FROM v_run_keywords GROUP BY ALL)
SELECT client, run_id, CASE WHEN run_id <= 3 THEN 'first' ELSE 'second' END AS commit, 'append' AS op, n_rows FROM n
UNION ALL SELECT client, run_id, 'retention', 'drop', 0 FROM n JOIN a USING (client, run_id) WHERE age > 4""")
def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.manifest(spark, _stored(spark, sf_dir), "keyword_snapshots").select(*KEYS, "commit", "op", "n_rows")


@query(ORACLES["run_summaries"])
def summary_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries as a published mart: written for all runs, then anew for the later ones; what a reader sees."""
    root = f"{shared_dir(spark)}/marts-{uuid.uuid4().hex}"
    rows = stored(run_summaries(spark, sf_dir), "run-summaries")
    snapshots.publish_mart(rows.withColumn("alerts", F.lit(-1).cast("long")).where("run_id > 3"), root, "run_summaries", "early")
    snapshots.publish_mart(rows, root, "run_summaries", "late")
    return snapshots.read(spark, root, "mart_run_summaries").select(rows.columns)
