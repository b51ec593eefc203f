"""Queries over runs, comparisons of runs, and real-user samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import competitors, diff, runs
from ..operators.keys import KEYS
from ..sources.shared import shared_dir
from ..streaming import rum
from . import views
from .audit_queries import _ON_PAGE, _PAGES, audits, pages
from .keyword_queries import _key, _samples, clients, serps
from .registry import ORACLES, query
from .views import with_views

_RUN = """
WITH r AS (SELECT concat('client', CAST(o_custkey % 20 AS STRING)) AS client, CAST(o_orderkey AS BIGINT) AS run_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'running' ELSE 'completed' END AS status, concat('h', CAST(o_custkey % 3 AS STRING)) AS config_hash FROM orders)"""


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of twenty clients, numbered by order."""
    views.tables(spark, sf_dir)
    return spark.sql(_RUN + " SELECT * FROM r")


@query(_RUN + """, d AS (SELECT client, max(CASE WHEN status = 'completed' THEN run_id END) AS done FROM r GROUP BY client)
SELECT r.client, max(run_id) AS latest_run, arg_max(status, run_id) AS latest_status, any_value(done) AS latest_completed_run,
  max(CASE WHEN status = 'completed' AND run_id < done THEN run_id END) AS previous_completed_run FROM r JOIN d USING (client) GROUP BY r.client""")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(run_rows(spark, sf_dir))


@query(_RUN + " SELECT client, run_id, max(CASE WHEN status = 'completed' THEN run_id END) OVER (PARTITION BY client ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run FROM r")
def previous_completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.previous_completed(run_rows(spark, sf_dir)).select("client", "run_id", "previous_run")


@query(_RUN + " SELECT client, run_id FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY run_id DESC) AS n FROM r) WHERE n <= 90")
def kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.prune(run_rows(spark, sf_dir), run_rows(spark, sf_dir)).select(*KEYS)


@query(_RUN + """, d AS (SELECT client, max(run_id) AS latest_run, arg_max(status, run_id) AS latest_status FROM r GROUP BY client),
c AS (SELECT DISTINCT concat('client', CAST(c_custkey % 25 AS STRING)) AS client FROM customer)
SELECT c.client, latest_run, latest_status FROM c LEFT JOIN d USING (client)""")
def client_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("client"), (F.col("c_custkey") % 25).cast("string")).alias("client"))
    return runs.client_status(every, run_rows(spark, sf_dir)).select("client", "latest_run", "latest_status")


@query(_RUN + ", d AS (SELECT client, arg_max(status, run_id) AS latest_status FROM r GROUP BY client) SELECT client FROM d WHERE latest_status = 'failed'")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark, sf_dir)
    return runs.failed_clients(runs.client_status(rows, rows)).select("client")


_RANKS = with_views("v_serp_prev") + """,
a AS (SELECT kw_id, min(position) AS previous_rank FROM v_serp_prev WHERE domain = 'client.com' GROUP BY kw_id),
b AS (SELECT kw_id, min(position) AS current_rank FROM v_serp WHERE domain = 'client.com' GROUP BY kw_id),
change AS (
  SELECT kw_id, CAST(previous_rank AS INTEGER) AS previous_rank, CAST(current_rank AS INTEGER) AS current_rank,
    CAST(coalesce(previous_rank, 11) - coalesce(current_rank, 11) AS INTEGER) AS delta
  FROM a FULL OUTER JOIN b USING (kw_id) WHERE previous_rank IS DISTINCT FROM current_rank)"""


def ranks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = views.view(spark, sf_dir, name).where("domain = client").groupBy("client", "kw_id").agg(F.min("position").cast("int").alias("client_rank"))
    return own.withColumnRenamed("kw_id", "keyword")


def _rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.rank_changes(ranks(spark, sf_dir, "v_serp_prev"), ranks(spark, sf_dir, "v_serp"))


@query(_RANKS + " SELECT * FROM change")
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_changes(spark, sf_dir).select(F.col("keyword").alias("kw_id"), "previous_rank", "current_rank", "delta")


@query(_RANKS + """ SELECT CASE WHEN kind = 'rank_gained' THEN 'info' ELSE 'warning' END AS severity, kind, subject FROM (
  SELECT CASE WHEN previous_rank IS NOT NULL AND current_rank IS NULL THEN 'rank_lost' WHEN previous_rank IS NULL THEN 'rank_gained' WHEN -delta >= 3 THEN 'rank_drop' END AS kind, CAST(kw_id AS VARCHAR) AS subject FROM change) WHERE kind IS NOT NULL""")
def rank_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.rank_alerts(_rank_changes(spark, sf_dir)).select("severity", "kind", "subject")


def _rates(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return competitors.real(competitors.discover(serps(spark, sf_dir, name), clients(spark), 0.05))


def _rate_sql(name: str) -> str:
    return f"SELECT domain FROM (SELECT DISTINCT kw_id, domain FROM {name}) WHERE domain <> 'client.com' AND domain NOT IN ('trendyol.com', 'shop.n11.com', 'onedio.com') GROUP BY domain HAVING count(*) / CAST((SELECT count(DISTINCT kw_id) FROM {name}) AS DOUBLE) >= 0.05 UNION SELECT 'absent-rival.com'"


@query(with_views("v_serp_prev") + f", a AS ({_rate_sql('v_serp_prev')}), b AS ({_rate_sql('v_serp')}) SELECT domain, 'entry' AS change FROM b WHERE domain NOT IN (SELECT domain FROM a) UNION ALL SELECT domain, 'exit' FROM a WHERE domain NOT IN (SELECT domain FROM b)")
def competitor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.entries_and_exits(_rates(spark, sf_dir, "v_serp_prev"), _rates(spark, sf_dir, "v_serp")).select("domain", "change")


def _audit_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = audits(spark, sf_dir)
    return rows.where("run_id = 0"), rows.where("run_id = 1")


@query(with_views("v_tech_audits") + " SELECT b.url, b.lcp_ms - a.lcp_ms AS lcp_delta_ms, b.inp_ms - a.inp_ms AS inp_delta_ms, round(b.cls - a.cls, 6) AS cls_delta FROM v_tech_audits a JOIN v_tech_audits b USING (url) WHERE a.run_id = 0 AND b.run_id = 1")
def cwv_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.cwv_deltas(*_audit_runs(spark, sf_dir)).select("url", "lcp_delta_ms", "inp_delta_ms", F.round("cls_delta", 6).alias("cls_delta"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    said = _samples(spark, sf_dir)
    return said.where("conv_id % 2 = 0"), said.where("conv_id % 2 = 1").withColumn("query", F.concat(F.lit("query "), ((F.col("conv_id") - 1) % 20).cast("string")))


def _said(which: int) -> str:
    return f"SELECT concat('query ', CAST((conv_id - {which}) % 20 AS VARCHAR)) AS query, avg(CASE WHEN contains({_key('text')}, 'ation') THEN 1 ELSE 0 END) AS rate FROM v_ai_answers WHERE conv_id % 2 = {which} GROUP BY 1"


@query(with_views("v_ai_answers") + f", a AS ({_said(0)}), b AS ({_said(1)}) SELECT query, round(a.rate, 6) AS previous_rate, round(b.rate, 6) AS current_rate FROM a JOIN b USING (query) WHERE a.rate <> b.rate")
def ai_rate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diff.ai_rate_deltas(*_answers(spark, sf_dir))
    return out.select("query", F.round("previous_rate", 6).alias("previous_rate"), F.round("current_rate", 6).alias("current_rate"))


_ALERTS = """
SELECT severity, kind, subject FROM ({ranks})
UNION ALL SELECT 'info', 'competitor_entry', domain FROM ({rivals}) WHERE change = 'entry'
UNION ALL SELECT 'warning', 'lcp_regression', url FROM ({vitals}) WHERE lcp_delta_ms > 500
UNION ALL SELECT 'warning', 'ai_rate_drop', query FROM ({answers}) WHERE previous_rate - current_rate >= 0.34""".format(**{k: ORACLES[n] for k, n in {"ranks": "rank_alerts", "rivals": "competitor_changes", "vitals": "cwv_deltas", "answers": "ai_rate_deltas"}.items()})


@query(f"SELECT 'client.com' AS client, * FROM ({_ALERTS})")
def trend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = diff.entries_and_exits(_rates(spark, sf_dir, "v_serp_prev"), _rates(spark, sf_dir, "v_serp"))
    return diff.alerts(_rank_changes(spark, sf_dir), changes, diff.cwv_deltas(*_audit_runs(spark, sf_dir)), diff.ai_rate_deltas(*_answers(spark, sf_dir)))


_EARLIER = _PAGES + ", p2 AS (SELECT * REPLACE (concat(title, ' - ', title) AS title) FROM p WHERE page_id % 3 <> 0), a AS (" + _ON_PAGE.replace(" FROM p WHERE", " FROM p2 WHERE") + "), b AS (" + _ON_PAGE + ")"


@query(_EARLIER + """ SELECT rule, url, 'new' AS change FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.rule = b.rule AND a.url = b.url)
UNION ALL SELECT rule, url, 'resolved' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.rule = b.rule AND a.url = b.url)""")
def findings_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-page findings of the crawl against an earlier one in which every third page was not there and titles were longer."""
    from ..operators import audit

    now = pages(spark, sf_dir)
    before = now.where("page_id % 3 <> 0").withColumn("title", F.concat("title", F.lit(" - "), "title"))
    return diff.findings_diff(audit.on_page(before), audit.on_page(now)).select("rule", "url", "change")


@query("SELECT 'client.com' AS client, CAST(count(*) - count(*) FILTER (WHERE page_id % 3 <> 0) AS BIGINT) AS page_count_delta FROM pages")
def page_count_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = views.view(spark, sf_dir, "v_crawl")
    return diff.page_count_delta(now.where("page_id % 3 <> 0"), now)


_RUM = with_views("v_rum_samples") + """,
n AS (SELECT url, metric, count(*) AS n FROM v_rum_samples WHERE metric <> 'OTHER' GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (SELECT url, metric, n, value FROM (SELECT s.*, n, row_number() OVER (PARTITION BY url, metric ORDER BY value, event_id) AS place FROM v_rum_samples s JOIN n USING (url, metric)) WHERE place = ceil(n * 0.75))"""


def rum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, "v_rum_samples").withColumnRenamed("event_id", "seq")


@query(_RUM + " SELECT url, metric, n, round(value, 6) AS value FROM p")
def rum_p75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rum.p75(rum_rows(spark, sf_dir)).select("url", "metric", "n", F.round("value", 6).alias("value"))


@query(_RUM + " SELECT url, round(max(CASE WHEN metric = 'LCP' THEN value END), 6) AS lcp_ms, round(max(CASE WHEN metric = 'INP' THEN value END), 6) AS inp_ms, round(max(CASE WHEN metric = 'CLS' THEN value END), 6) AS cls FROM p GROUP BY url HAVING max(CASE WHEN metric <> 'TTFB' THEN 1 END) = 1")
def field_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rum.field_audits(rum.p75(rum_rows(spark, sf_dir)))
    return out.select("url", *(F.round(c, 6).alias(c) for c in ("lcp_ms", "inp_ms", "cls")))


# every sample's attribution: five parts of its first byte and the element that it names, from its own number
_PARTS = ("waitingDuration", "cacheDuration", "dnsDuration", "connectionDuration", "requestDuration")


def attributed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(F.col("seq") * (3 + 2 * i) % 41).alias(p) for i, p in enumerate(_PARTS)]
    told = F.when(F.col("seq") % 10 > 0, F.to_json(F.struct(F.concat(F.lit("#e"), F.col("seq") % 5).alias("target"), *parts)))
    return rum_rows(spark, sf_dir).withColumn("attribution", told)


@query(_RUM.replace("SELECT url, metric, n, value FROM (", "SELECT url, metric, n, value, event_id FROM (") + """,
t AS (SELECT url, event_id, [event_id * 3 % 41, event_id * 5 % 41, event_id * 7 % 41, event_id * 9 % 41, event_id * 11 % 41] AS parts FROM p WHERE metric = 'TTFB' AND event_id % 10 > 0),
a AS (SELECT url, round(max(CASE WHEN metric = 'TTFB' THEN value END), 6) AS ttfb_ms, max(CASE WHEN metric = 'LCP' AND event_id % 10 > 0 THEN concat('#e', CAST(event_id % 5 AS VARCHAR)) END) AS lcp_target
  FROM p GROUP BY url HAVING max(CASE WHEN metric <> 'TTFB' THEN 1 END) = 1)
SELECT a.url, ttfb_ms, lcp_target, ['waitingDuration', 'cacheDuration', 'dnsDuration', 'connectionDuration', 'requestDuration'][list_position(parts, list_max(parts))] AS ttfb_phase, CAST(parts[1] AS DOUBLE) AS waiting FROM a LEFT JOIN t USING (url)""")
def field_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field audits with the attribution of the samples at the percentiles and the largest part of the first byte."""
    out = rum.field_audits(rum.p75(attributed_rows(spark, sf_dir)))
    return out.select("url", F.round("ttfb_ms", 6).alias("ttfb_ms"), F.col("attribution.lcp.target").alias("lcp_target"), "ttfb_phase", F.col("attribution.ttfb.waitingDuration").alias("waiting"))


@query(with_views("v_rum_samples") + " SELECT 'client.com' AS client, count(*) AS samples, count(DISTINCT url) AS urls FROM v_rum_samples")
def rum_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rum.status(rum_rows(spark, sf_dir))


_PAYLOADS = with_views("v_rum_samples") + """,
g AS (SELECT event_id // 7 AS payload, count(*) AS n, bool_and(metric <> 'OTHER' AND value >= 0) AS ok FROM v_rum_samples GROUP BY 1)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as beacons of seven neighbours each, in JSON."""
    rows = rum_rows(spark, sf_dir)
    sample = F.struct("url", "metric", "value", F.lit("good").alias("rating"), F.lit("navigate").alias("navigationType"))
    grouped = rows.groupBy("client", F.floor(F.col("seq") / 7).alias("payload_id")).agg(F.to_json(F.sort_array(F.collect_list(sample))).alias("payload"))
    return grouped.withColumn("origin", F.lit("https://client.com"))


@query(_PAYLOADS + " SELECT payload AS payload_id, n AS n_samples, ok AS accepted FROM g")
def rum_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rum.validate(payloads(spark, sf_dir)).select("payload_id", F.size("samples").cast("long").alias("n_samples"), "accepted")


@query(_PAYLOADS + """, s AS (SELECT v.* FROM v_rum_samples v JOIN g ON payload = event_id // 7 AND ok),
k AS (SELECT url, metric, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT url, metric, n, round(value, 6) AS value FROM (SELECT s.*, n, row_number() OVER (PARTITION BY url, metric ORDER BY value, event_id) AS place FROM s JOIN k USING (url, metric)) WHERE place = ceil(n * 0.75)""")
def rum_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beacons through the stream: landed as two files, one micro-batch each, percentiles from its sink."""
    root = f"{shared_dir(spark)}/rum-{uuid.uuid4().hex}"
    payloads(spark, sf_dir).select("client", "origin", "payload").repartition(2).write.json(f"{root}/landed")
    stream = rum.start(spark, f"{root}/landed", root, files_per_batch=1)
    stream.awaitTermination()
    return rum.current_p75(spark, root, rum.last_batch(stream)).select("url", "metric", "n", F.round("value", 6).alias("value"))


