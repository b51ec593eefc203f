"""Queries over all findings together, and of the small steps between sources and findings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import excluded_path, same_site, url_host
from ..operators import ai, audit, codeaudit, competitors, diff, findings, keywords, marts, runs, vitals
from ..operators.keys import KEYS
from ..sources import configs, ingest
from ..sources.shared import shared_dir
from ..streaming import rum
from . import views
from .audit_queries import audits, crawl, site_findings, sitemap, whole_texts, with_page
from .ingest_queries import ingest_keyword_gaps, lab_payloads, source_files
from .keyword_queries import _CANNIBAL, _COMPETITORS, _competitors, _rivals, _samples, clients, keyword_rows, serps
from .registry import ORACLES, query
from .run_queries import _RUN, run_rows, trend_alerts
from .views import with_views

_CONTENT = with_views("v_serp", "v_keywords") + """, named AS (SELECT kw_id, min(keyword) AS keyword FROM v_serp GROUP BY kw_id)
SELECT 'content_gap' AS rule, 'content' AS category, 'medium' AS severity, CAST(NULL AS VARCHAR) AS url, keyword AS evidence, 25 AS impact, -1 AS page
FROM v_keywords JOIN named USING (kw_id) WHERE volume >= 500 AND kw_id NOT IN (SELECT kw_id FROM v_serp WHERE domain = 'client.com')"""
_COMPETING = with_views("v_search_performance") + _CANNIBAL.replace("\nSELECT query", ",\nx AS (SELECT query", 1).replace("round(max(share), 6)", "max(share)") + """)
SELECT 'cannibalization' AS rule, 'content' AS category, 'high' AS severity, "primary" AS url, concat("primary", ' ', primary_impressions, ' ', secondary_pages) AS evidence, impact, -1 AS page, top_share AS share, query AS detail FROM x"""
_FAMILIES = (
    "on_page_findings", "link_findings", "redirect_findings", "crawlability_findings", "duplicate_findings", "missing_hreflang", "canonical_findings", "schema_findings",
    _CONTENT, "indexing_findings", _COMPETING,
)
_COUNTED = "('multiple_h1', 'deep_page', 'images_missing_alt', 'images_missing_dimensions', 'redirect_chain', 'mixed_content', 'schema_required_fields', 'content_gap')"


def _family(nr: int, source: str) -> str:
    last = "share, detail" if source is _COMPETING else "CAST(NULL AS DOUBLE) AS share, CAST(NULL AS VARCHAR) AS detail"
    return f"SELECT {nr} AS family, rule, category, severity, url, evidence, impact, page, {last} FROM ({with_page(ORACLES.get(source, source))})"


_SITE_FINDINGS = "WITH told AS (" + " UNION ALL ".join(_family(nr, source) for nr, source in enumerate(_FAMILIES)) + f"""),
titled AS (
  SELECT t.*, list_position(['critical', 'high', 'medium', 'low'], severity) AS grade,
    concat(replace(rule, '_', ' '), ' (' || CASE WHEN rule IN {_COUNTED} THEN evidence WHEN rule IN ('sitemap_not_crawled', 'crawled_not_in_sitemap') THEN split_part(evidence, ':', 1)
      WHEN rule IN ('duplicate_title', 'duplicate_h1') THEN split_part(evidence, ' ', 1) WHEN rule = 'broken_link' THEN split_part(evidence, ' ', 2) ELSE detail END || ')') AS title
  FROM told t),
site AS (SELECT *, row_number() OVER (ORDER BY family, page, rule, coalesce(url, ''), evidence) AS seq FROM titled)"""

_CAPPED = _SITE_FINDINGS + """,
ruled AS (SELECT *, concat(category, '|', regexp_replace(title, '[0-9]+([.,][0-9]+)?', 'N', 'g')) AS rule_id FROM site),
sized AS (SELECT *, count(*) OVER r = count(url) OVER r AND count(*) OVER r > 3 AS wide, count(*) OVER r AS n, min(title) OVER r <> max(title) OVER r AS differ, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS nth
  FROM ruled WINDOW r AS (PARTITION BY rule_id)),
one AS (
  SELECT rule, title, severity, grade, url, evidence, impact, share, seq FROM sized WHERE NOT wide
  UNION ALL
  SELECT arg_min(rule, nth), arg_min(title, nth), arg_min(severity, nth), arg_min(grade, nth), NULL,
    concat(n, ' pages', CASE WHEN differ THEN ' (numbers differ)' ELSE '' END, ': ', string_agg(url, ', ' ORDER BY nth), CASE WHEN n > 5 THEN concat(' (+', n - 5, ')') ELSE '' END),
    arg_min(impact, nth), min(CASE WHEN nth = 1 THEN share END), min(seq)
  FROM sized WHERE wide AND nth <= 5 GROUP BY rule_id, n, differ),
placed AS (SELECT *, row_number() OVER (ORDER BY grade, coalesce(share, 0) DESC, seq) AS place, count(*) OVER () AS every FROM one)
SELECT place, rule, title, severity, url, evidence, impact, greatest(every - 50, 0) AS hidden FROM placed WHERE place <= 50"""


@query(_CAPPED)
def cap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.cap_findings(site_findings(spark, sf_dir), 50).select("place", "rule", "title", "severity", "url", "evidence", "impact", "hidden")


@query(whole_texts(_SITE_FINDINGS) + """ SELECT url, count(*) OVER u AS n_findings, max(impact) OVER u AS impact, min(grade) OVER u AS worst,
  row_number() OVER (PARTITION BY url ORDER BY grade, coalesce(share, 0) DESC, family, page, rule, evidence, title) AS place, rule, category, severity, title, evidence, impact AS own_impact, share AS phase_share
FROM site WINDOW u AS (PARTITION BY url)""")
def findings_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of all findings under their URLs; texts of pages are read to their ends."""
    out = findings.by_url(site_findings(spark, sf_dir, whole=True))
    return out.select("url", "n_findings", "impact", "worst", "place", "rule", "category", "severity", "title", "evidence", "own_impact", "phase_share")


@query(_SITE_FINDINGS + f" SELECT 'client.com' AS client, rule, title, url FROM site UNION ALL SELECT client, rule, replace(rule, '_', ' '), url FROM ({ORACLES['code_findings']})")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's findings and those of the source code."""
    files = source_files(spark, sf_dir)
    stacks = codeaudit.detect_stack(files)
    code = codeaudit.file_findings(files, stacks).unionByName(codeaudit.project_findings(files, stacks))
    return findings.all_findings(site_findings(spark, sf_dir).drop("seq"), code).select("client", "rule", "title", "url")


@query(f"SELECT rule, url, true AS is_mock FROM ({ORACLES['redirect_findings']}) UNION ALL SELECT rule, url, false FROM ({ORACLES['indexing_findings']})")
def mark_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of links and of the index in a run whose links are synthetic."""
    found = audit.redirects(crawl(spark, sf_dir), sitemap(spark, sf_dir)).unionByName(audit.indexing(views.view(spark, sf_dir, "v_index_status")))
    made = found.select(*KEYS).distinct().withColumn("mock_categories", F.array(F.lit("links")))
    return findings.mark_synthetic(found, made).select("rule", "url", "is_mock")


# -- actions

_VITALS = ORACLES["vitals_diagnosis"].replace("round(", "(").replace(", 6) AS phase_share", ") AS phase_share")
_SCORES = ORACLES["rank_opportunities"].replace("SELECT kw_id, score, row_number()", "SELECT keyword, score, volume, row_number()")
_GRADE = "list_position(['critical', 'high', 'medium', 'low'], severity)"
_CANDIDATES = _CAPPED[: _CAPPED.rindex(",\nplaced AS")].replace("rule, title, severity, grade, url,", "rule, category, title, severity, grade, url,").replace("arg_min(rule, nth), arg_min(title", "arg_min(rule, nth), arg_min(category, nth), arg_min(title") + f""",
vitals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_GRADE}, coalesce(phase_share, 0) DESC, rule) AS nth FROM ({_VITALS}) WHERE run_id = 1) WHERE nth <= 2),
onpage AS (SELECT *, row_number() OVER (ORDER BY grade, coalesce(share, 0) DESC, seq) AS nth FROM site WHERE category = 'onpage'),
crawled AS (SELECT *, row_number() OVER (ORDER BY grade, coalesce(share, 0) DESC, seq) AS nth FROM one WHERE category NOT IN ('onpage', 'indexing')),
code AS (SELECT *, row_number() OVER (ORDER BY {_GRADE}, url, rule) AS nth
  FROM (SELECT rule, url, CASE rule WHEN 'missing_metadata' THEN 'high' WHEN 'no_https_rule' THEN 'medium' ELSE 'low' END AS severity FROM ({ORACLES["code_findings"]}) WHERE url IS NOT NULL)),
action AS (
  SELECT CASE WHEN severity = 'warning' THEN 1 ELSE 3 END AS priority, 0 AS branch, 'trend' AS kind, subject AS text, row_number() OVER (ORDER BY subject) AS own FROM ({ORACLES["trend_alerts"]})
  UNION ALL SELECT 2, 1, 'opportunity', keyword, row_number() OVER (ORDER BY score DESC, volume DESC, keyword) AS own FROM ({_SCORES}) QUALIFY own <= 5
  UNION ALL SELECT CASE WHEN severity = 'critical' THEN 1 ELSE 2 END, 2, 'technical', concat(rule, ' ', url), row_number() OVER (ORDER BY url, nth) FROM vitals
  UNION ALL SELECT CASE WHEN severity = 'critical' THEN 1 ELSE 2 END, 3, 'on-page', concat_ws(' ', rule, url), nth FROM onpage WHERE nth <= 5
  UNION ALL SELECT 1, 4, 'indexing', concat_ws(' ', rule, url), seq FROM site WHERE category = 'indexing'
  UNION ALL SELECT CASE WHEN severity = 'critical' THEN 1 ELSE 2 END, 5, 'crawl', concat_ws(' ', rule, url), nth FROM crawled WHERE nth <= 5
  UNION ALL SELECT CASE WHEN severity = 'critical' THEN 1 ELSE 2 END, 6, 'code', concat(rule, ' ', url), nth FROM code WHERE nth <= 5
  UNION ALL SELECT 2, 7, 'ai-visibility', query, row_number() OVER (ORDER BY query) FROM ({ORACLES["ai_visibility"]}) WHERE is_gap
  UNION ALL SELECT 3, 8, 'keyword-gap', keyword, row_number() OVER (ORDER BY coalesce(volume, -1) DESC, keyword) AS own FROM ({ORACLES["ingest_keyword_gaps"]}) QUALIFY own <= 3),
candidate AS (SELECT priority, branch, kind, text, CAST(row_number() OVER (PARTITION BY branch ORDER BY priority, own) AS INTEGER) AS place_in_branch FROM action QUALIFY place_in_branch <= 12)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl_ = site_findings(spark, sf_dir)
    own = vitals.diagnose(audits(spark, sf_dir).where("run_id = 1")).withColumn("seq", F.struct("url", "rule"))
    files = source_files(spark, sf_dir)
    code = codeaudit.file_findings(files, codeaudit.detect_stack(files)).withColumns({"seq": F.struct("url", "rule"), "client": F.lit(views.CLIENT)})
    return marts.action_candidates(
        trend_alerts(spark, sf_dir).withColumn("run_id", F.lit(1)), keywords.opportunities(keyword_rows(spark, sf_dir), serps(spark, sf_dir)), own,
        crawl_.where("category = 'onpage'"), crawl_.where("category = 'indexing'"), crawl_.where("category not in ('onpage', 'indexing')"), code,
        ai.visibility(_samples(spark, sf_dir), _rivals(spark)).where("is_gap"), ingest_keyword_gaps(spark, sf_dir).withColumns({"client": F.lit(views.CLIENT), "run_id": F.lit(1)}),
    )


@query(_CANDIDATES + " SELECT priority, kind, text, place_in_branch FROM candidate")
def action_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve actions of every branch."""
    return _actions(spark, sf_dir).select("priority", "kind", "text", F.col("at").alias("place_in_branch"))


@query(_CANDIDATES + " SELECT CAST(row_number() OVER (ORDER BY priority, branch, place_in_branch) AS INTEGER) AS place, priority, kind, text FROM candidate QUALIFY place <= 12")
def prioritized_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.prioritized_actions(_actions(spark, sf_dir)).select("place", "priority", "kind", "text")


# -- rows that sources repeat


@query("SELECT l_suppkey AS source, l_partkey AS target, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2")
def dedupe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.col("l_suppkey").alias("source_url"), F.col("l_partkey").alias("target_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return runs.first_rows(rows, "page_links").select(F.col("source_url").alias("source"), F.col("target_url").alias("target"), "seq")


@query("SELECT o_custkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'PHONE' ELSE 'DESKTOP' END AS form_factor, arg_min(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS lcp_ms FROM orders GROUP BY 1, 2")
def dedupe_field_cwv(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("o_orderkey") % 2 == 0, "PHONE").otherwise("DESKTOP")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.col("o_custkey").alias("url"), form.alias("form_factor"), F.floor("o_totalprice").alias("lcp_ms"), F.col("o_orderkey").alias("seq"))
    return runs.first_rows(rows, "field_cwv").select("url", "form_factor", "lcp_ms")


@query("SELECT concat('k', l_partkey) AS keyword, concat('rival', l_suppkey % 4, '.com') AS competitor_domain, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2")
def dedupe_keyword_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.concat(F.lit("k"), "l_partkey").alias("keyword"),
        F.concat(F.lit("rival"), F.col("l_suppkey") % 4, F.lit(".com")).alias("competitor_domain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return runs.first_rows(rows, "keyword_gaps").select("keyword", "competitor_domain", "seq")


@query(with_views("v_serp") + " SELECT kw_id, array_to_string(list(concat(position, ' ', domain) ORDER BY position), ',') AS entries, bool_or(position % 7 = 0) AS snippet, bool_or(position = 1 AND kw_id % 2 = 0) AS ai FROM v_serp GROUP BY kw_id")
def regroup_serps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages from their rows; one row of a page at most carries its flag."""
    rows = views.view(spark, sf_dir, "v_serp").withColumns({"has_featured_snippet": F.col("position") % 7 == 0, "has_ai_overview": (F.col("position") == 1) & (F.col("kw_id") % 2 == 0)})
    out = keywords.regroup(rows.drop("keyword").withColumnRenamed("kw_id", "keyword"))
    return out.select(F.col("keyword").alias("kw_id"), F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", e["position"], e["domain"])), ",").alias("entries"), F.col("has_featured_snippet").alias("snippet"), F.col("has_ai_overview").alias("ai"))


# -- what a run looks up


@query(f"SELECT url, min(place) AS place FROM (SELECT 'https://client.com/' AS url, 0 AS place UNION ALL SELECT url, place FROM ({ORACLES['select_audit_urls']})) GROUP BY url")
def crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serps(spark, sf_dir)
    return keywords.crawl_seeds(rows, keywords.select_audit_urls(rows, clients(spark))).select("url", "place")


@query(with_views("v_serp") + "," + _COMPETITORS + " SELECT 'client.com' AS domain UNION SELECT 'absent-rival.com' UNION (SELECT domain FROM competitor WHERE is_real_competitor ORDER BY rate DESC, domain LIMIT 5)")
def backlink_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competitors.backlink_domains(_competitors(spark, sf_dir), clients(spark)).select("domain")


@query(f"SELECT DISTINCT kind, subject FROM ({ORACLES['lab_issue_list']})")
def distinct_client_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.distinct_client_issues(ingest.lab_issues(ingest.lab_audit(lab_payloads(spark, sf_dir))[0])).select("kind", "subject")


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '')"
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/')"


@query(f"""SELECT page_id, {_PATH} = '/en' OR starts_with({_PATH}, '/en/') OR {_PATH} = '/fr/8' OR starts_with({_PATH}, '/fr/8/') AS excluded, page_id % 2 = 0 AS same_site FROM pages""")
def crawl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded paths go by whole segments; every second page is asked for another domain than its own."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    domain = F.when(F.col("page_id") % 2 == 0, url_host(F.col("url"))).otherwise("elsewhere.example")
    return rows.select("page_id", excluded_path(F.col("url"), F.array(F.lit("/en"), F.lit("/fr/8"))).alias("excluded"), same_site(F.col("url"), domain).alias("same_site"))


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), d AS (SELECT host, concat('https://', host, '/maps/', page_id % 4, '.xml') AS sitemap FROM h WHERE page_id % 9 = 0)
SELECT DISTINCT host, sitemap FROM d UNION SELECT host, concat('https://', host, '/sitemap.xml') FROM h WHERE host NOT IN (SELECT host FROM d)""")
def sitemap_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url_host(F.col("url")).alias("host"))
    declared = hosts.where("page_id % 9 = 0").select("host", F.concat(F.lit("https://"), "host", F.lit("/maps/"), F.col("page_id") % 4, F.lit(".xml")).alias("sitemap"))
    return ingest.sitemap_addresses(hosts, declared)


@query("SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - 30 AS VARCHAR) AS start_date, CAST(CAST(ts AS DATE) - 3 AS VARCHAR) AS end_date FROM events".replace("CAST(ts AS DATE) AS day", "CAST(CAST(ts AS DATE) AS VARCHAR) AS day"))
def reporting_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a report made on each day that has events."""
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("now")).distinct()
    window = ingest.reporting_window(F.col("now"))
    return days.select(F.col("now").cast("string").alias("day"), *(c.cast("string").alias(name) for name, c in window.items()))


# -- configurations and runs

_CONFIG = """
WITH c AS (SELECT c_custkey AS id, concat('c', c_custkey % 50, '.com') AS domain, c_custkey % 8 AS kind FROM customer),
r AS (SELECT *, CASE kind WHEN 1 THEN 'brandTokens' WHEN 2 THEN 'domain' WHEN 3 THEN 'crawlMaxPages' WHEN 4 THEN 'auditUrls,mockSeed' WHEN 5 THEN 'json' ELSE '' END AS errors FROM c)"""


def config_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for every customer, by number: whole, without tokens, without a domain, without pages, with a bad URL and a
    seed in words, cut off, with values of its own, and with its lists in another order."""
    kind = F.col("c_custkey") % 8
    domain = F.when(kind == 2, F.lit("")).otherwise(F.concat(F.lit("c"), F.col("c_custkey") % 50, F.lit(".com")))
    tokens = F.when(kind == 1, "").otherwise('"brandTokens":["a"],')
    words = F.when(kind == 7, '["y","x"]').otherwise('["x","y"]')
    more = F.when(kind == 3, ',"crawlMaxPages":0').when(kind == 4, ',"auditUrls":["nowhere"],"mockSeed":"one"').when(kind == 5, ",,").when(kind == 6, ',"crawlMaxPages":60,"locale":"en-GB","crawlEnabled":false').otherwise("")
    payload = F.concat(F.lit('{"domain":"'), domain, F.lit('","brandName":"B",'), tokens, F.lit('"seedKeywords":'), words, more, F.lit("}"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), payload.alias("payload"))


@query(_CONFIG + " SELECT id, errors, domain, CASE WHEN kind = 6 THEN 60 ELSE 300 END AS crawl_max_pages, CASE WHEN kind = 6 THEN 'en-GB' ELSE 'tr-TR' END AS locale, kind <> 6 AS crawl_enabled FROM r WHERE errors = '' UNION ALL SELECT id, errors, NULL, NULL, NULL, NULL FROM r WHERE errors <> ''")
def project_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = configs.read(config_payloads(spark, sf_dir))
    columns = ("domain", "crawl_max_pages", "locale", "crawl_enabled")
    return good.select("id", F.lit("").alias("errors"), *columns).unionByName(bad.select("id", F.array_join("errors", ",").alias("errors")), allowMissingColumns=True)


@query(_CONFIG + """ SELECT id, left(sha256(concat('{"domain":"', domain, '","seed_keywords":["x","y"],"seed_competitors":[],"ai_queries":[]}')), 12) AS config_hash FROM r WHERE errors = ''""")
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a list does not change the hash."""
    return runs.config_hash(configs.read(config_payloads(spark, sf_dir))[0]).select("id", "config_hash")


@query(_RUN + " SELECT client, run_id, CASE WHEN status = 'running' AND run_id % 3 = 0 THEN 'failed' ELSE status END AS status, config_hash FROM r")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run starts, may be closed, and every third one is told again that it failed, which only a running one takes."""
    rows = run_rows(spark, sf_dir)
    started = rows.withColumns({"status": F.lit("running"), "ts": F.lit(0)})
    closed = rows.where("status <> 'running'").withColumn("ts", F.lit(1))
    late = rows.where("run_id % 3 = 0").withColumns({"status": F.lit("failed"), "ts": F.lit(2)})
    return runs.run_states(started.unionByName(closed).unionByName(late)).select(*KEYS, "status", "config_hash")


@query(_RUN + """, q AS (SELECT *, max(CASE WHEN status = 'completed' THEN run_id END) OVER (PARTITION BY client ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_run FROM r)
SELECT q.client, q.run_id, q.previous_run, q.previous_run IS NULL AS is_baseline, coalesce(b.config_hash <> q.config_hash, false) AS config_mismatch FROM q LEFT JOIN r b ON b.client = q.client AND b.run_id = q.previous_run""")
def run_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.baselines(run_rows(spark, sf_dir)).select(*KEYS, "previous_run", "is_baseline", "config_mismatch")


@query(with_views("v_search_performance") + " SELECT query, nullif(page, '') AS page, clicks, round(clicks / CAST(impressions AS DOUBLE), 4) AS ctr, round(impressions / CAST(7 AS DOUBLE), 2) AS avg_position FROM v_search_performance")
def search_rows_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search rows as a file with fixed decimals, read back."""
    rows = views.view(spark, sf_dir, "v_search_performance").withColumns({"ctr": F.col("clicks") / F.col("impressions"), "avg_position": F.col("impressions") / F.lit(7.0)})
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    marts.write_search_rows(rows, path)
    schema = "client string, run_id int, query string, page string, clicks bigint, impressions bigint, ctr double, avg_position double"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).select("query", F.nullif("page", F.lit("")).alias("page"), "clicks", "ctr", "avg_position")


_FIELD_ROWS = "SELECT concat(CASE WHEN o_custkey % 4 = 0 THEN 'https://rival.com/' ELSE 'https://www.client.com/' END, o_custkey) AS url, max(CAST(floor(o_totalprice) AS BIGINT)) AS lcp_ms FROM orders GROUP BY 1"


@query(f"SELECT url, lcp_ms, url LIKE '%client.com%' AS is_client, row_number() OVER (ORDER BY url LIKE '%client.com%' DESC, url) AS place FROM ({_FIELD_ROWS})")
def field_cwv_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.tables(spark, sf_dir)
    rows = spark.sql(_FIELD_ROWS).withColumns({"client": F.lit(views.CLIENT), "run_id": F.lit(1)})
    return marts.field_cwv_comparison(rows).select("url", "lcp_ms", "is_client", "place")


@query("SELECT event_id FROM events WHERE event_id % 3 = 2 OR (event_id % 3 = 0 AND user_id % 4 < 2) OR (event_id % 3 = 1 AND user_id % 4 = 2)")
def allowed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three clients one lists two origins, one lists one, and one none."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("client"), F.col("event_id") % 3).alias("client"), F.concat(F.lit("https://o"), F.col("user_id") % 4, F.lit(".com")).alias("origin"))
    listed = spark.createDataFrame([("client0", "https://o0.com"), ("client0", "https://o1.com"), ("client1", "https://o2.com")], "client string, origin string")
    return rum.allowed_origin(rows, listed).select("event_id")
