"""Queries that land JSON made from the given tables and read it back, audit source files, and build marts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codeaudit, findings, marts
from ..operators.keys import KEYS
from ..sources import html_pages, ingest, source_tree
from ..sources.shared import shared_dir
from . import views
from .audit_queries import _ON_PAGE, _PAGES, audits, pages
from .keyword_queries import _COMPETITORS, _competitors, _rivals, _samples, keyword_rows
from .registry import query
from .run_queries import _rank_changes
from .views import with_views


def serp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages as search payloads; every thirteenth is an error, every seventeenth lacks its results."""
    rows = views.view(spark, sf_dir, "v_serp")
    results = F.transform(F.sort_array(F.collect_list(F.struct("position", "url"))), lambda r: F.struct((r["position"] + 5).alias("position"), r["url"].alias("link")))
    grouped = rows.groupBy(*KEYS, "kw_id", "keyword", "has_featured_snippet", "has_ai_overview").agg(results.alias("organic_results"))
    payload = F.to_json(F.struct(
        F.when(F.col("kw_id") % 13 == 0, "quota").alias("error"), F.when(F.col("kw_id") % 17 > 0, F.col("organic_results")).alias("organic_results"),
        F.when(F.col("has_featured_snippet"), F.struct(F.lit("x").alias("title"))).alias("answer_box"), F.when(F.col("has_ai_overview"), F.struct(F.lit("y").alias("text"))).alias("ai_overview"),
    ))
    return grouped.select(*KEYS, "kw_id", "keyword", payload.alias("payload"))


@query(with_views("v_serp") + r"""
SELECT keyword, position, regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '^www\.', '') AS domain, url, has_featured_snippet, has_ai_overview
FROM v_serp WHERE kw_id % 13 <> 0 AND kw_id % 17 <> 0""")
def ingest_serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.serp(serp_payloads(spark, sf_dir))[0].drop(*KEYS)


@query(with_views("v_serp") + """
SELECT CASE WHEN kw_id % 13 = 0 THEN 'quota' ELSE 'no organic_results' END AS reason, count(DISTINCT kw_id) AS n FROM v_serp WHERE kw_id % 13 = 0 OR kw_id % 17 = 0 GROUP BY 1""")
def ingest_serp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.serp(serp_payloads(spark, sf_dir))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def metric_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword figures in the envelope, ten parts to an answer; every eleventh answer failed."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    level = F.when(F.col("p_size") % 4 == 0, "low").when(F.col("p_size") % 4 == 1, "MEDIUM").when(F.col("p_size") % 4 == 2, "HIGH")
    item = F.struct(
        F.concat(F.lit("PART "), F.col("p_partkey").cast("string")).alias("keyword"), F.floor("p_retailprice").alias("search_volume"), level.alias("competition"),
        F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") * 3).cast("double")).alias("competition_index"), F.col("p_size").cast("double").alias("cpc"),
    )
    grouped = parts.where("p_partkey % 5 <> 0").groupBy(F.floor(F.col("p_partkey") / 10).alias("answer")).agg(F.sort_array(F.collect_list(item)).alias("result"))
    task = F.struct(F.lit(20000).alias("status_code"), F.col("result"))
    payload = F.to_json(F.struct(F.when(F.col("answer") % 11 == 0, 40100).otherwise(20000).alias("status_code"), F.array(task).alias("tasks")))
    return grouped.select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), "answer", payload.alias("payload"))


@query("""
SELECT concat('part ', CAST(p_partkey AS VARCHAR)) AS keyword, CASE WHEN ok THEN CAST(floor(p_retailprice) AS BIGINT) ELSE 0 END AS volume,
  CASE WHEN NOT ok THEN 0.0 WHEN p_partkey % 3 = 0 THEN greatest(least(p_size * 3 / CAST(100 AS DOUBLE), 1), 0) WHEN p_size % 4 = 0 THEN 0.25 WHEN p_size % 4 = 1 THEN 0.5 WHEN p_size % 4 = 2 THEN 0.85 ELSE 0.0 END AS difficulty,
  CASE WHEN ok THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS cpc
FROM (SELECT *, p_partkey % 5 <> 0 AND (p_partkey // 10) % 11 <> 0 AS ok FROM part)""")
def ingest_keyword_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("keyword"))
    good, _ = ingest.envelope(metric_payloads(spark, sf_dir))
    return ingest.keyword_metrics(wanted, good).drop(*KEYS)


@query("SELECT '40100' AS reason, count(*) AS n FROM (SELECT DISTINCT p_partkey // 10 AS a FROM part WHERE p_partkey % 5 <> 0) WHERE a % 11 = 0")
def envelope_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.envelope(metric_payloads(spark, sf_dir))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('s', CAST(s_suppkey AS VARCHAR), '.com') AS domain, CAST(s_suppkey % 50 AS BIGINT) AS ref_domains, CAST(s_suppkey * 7 AS BIGINT) AS backlink_count, round(coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 1000 END, 0) / CAST(10 AS DOUBLE), 6) AS domain_authority FROM supplier")
def ingest_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    item = F.struct((F.col("s_suppkey") % 50).alias("referring_domains"), (F.col("s_suppkey") * 7).alias("backlinks"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 1000).alias("rank"))
    payload = F.to_json(F.struct(F.lit(20000).alias("status_code"), F.array(F.struct(F.lit(20000).alias("status_code"), F.array(item).alias("result"))).alias("tasks")))
    landed = rows.select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"), payload.alias("payload"))
    return ingest.backlinks(ingest.envelope(landed)[0]).select("domain", "ref_domains", "backlink_count", F.round("domain_authority", 6).alias("domain_authority"))


@query("""
SELECT concat('k', CAST(p_partkey AS VARCHAR)) AS keyword, concat('rival', CAST(p_size % 4 AS VARCHAR), '.com') AS competitor_domain, CAST(p_size AS INTEGER) AS competitor_position,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS BIGINT) END AS volume
FROM part WHERE p_partkey % 5 IN (0, 1) AND p_partkey % 7 <> 0""")
def ingest_keyword_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's element is absent, null, empty-ranked (null) or ranked, by number; the rival's rank is null at times."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = F.element_at(F.array(F.lit('"x":1'), F.lit('"first_domain_serp_element":null'), F.lit('"first_domain_serp_element":{"rank_absolute":null}'), F.lit('"first_domain_serp_element":{"rank_absolute":3}'), F.lit('"first_domain_serp_element":{"rank_absolute":9}')), (F.col("p_partkey") % 5 + 1).cast("int"))
    volume = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("null")
    rival = F.when(F.col("p_partkey") % 7 == 0, "null").otherwise(F.col("p_size").cast("string"))
    item = F.format_string('{"keyword_data":{"keyword":"k%d","keyword_info":{"search_volume":%s}},%s,"second_domain_serp_element":{"rank_absolute":%s}}', "p_partkey", volume, own, rival)
    grouped = rows.groupBy((F.col("p_size") % 4).alias("r"), (F.col("p_partkey") % 97).alias("b")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    landed = grouped.select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.concat(F.lit("rival"), F.col("r").cast("string"), F.lit(".com")).alias("competitor_domain"), F.array(F.concat(F.lit('{"items":['), F.col("items"), F.lit("]}"))).alias("result"))
    return ingest.keyword_gaps(landed).drop(*KEYS)


@query(with_views("v_search_performance") + " SELECT query, page, clicks, impressions, round(clicks / CAST(impressions AS DOUBLE), 4) AS ctr FROM v_search_performance")
def ingest_search_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(spark, sf_dir, "v_search_performance")
    row = F.struct(F.array("query", "page").alias("keys"), "clicks", "impressions", (F.col("clicks") / F.col("impressions")).alias("ctr"), F.lit(1.5).alias("position"))
    short = F.struct(F.array("query").alias("keys"), "clicks", "impressions", F.lit(0.0).alias("ctr"), F.lit(1.5).alias("position"))
    landed = rows.groupBy(*KEYS, "query").agg(F.to_json(F.struct(F.concat(F.collect_list(row), F.slice(F.collect_list(short), 1, 1)).alias("rows"))).alias("payload"))
    return ingest.search_performance(landed)[0].select("query", "page", "clicks", "impressions", "ctr")


@query(with_views("v_index_status") + " SELECT url, 'bilinmiyor' AS coverage_state, CASE WHEN indexing_state = 'INDEXING_STATE_UNSPECIFIED' THEN 'INDEXING_STATE_UNSPECIFIED' ELSE indexing_state END AS indexing_state, page_fetch_state, google_canonical, user_canonical FROM v_index_status")
def ingest_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(spark, sf_dir, "v_index_status")
    status = F.struct(F.nullif("indexing_state", F.lit("INDEXING_STATE_UNSPECIFIED")).alias("indexingState"), F.col("page_fetch_state").alias("pageFetchState"), F.col("google_canonical").alias("googleCanonical"), F.col("user_canonical").alias("userCanonical"))
    landed = rows.select(*KEYS, "url", F.to_json(F.struct(F.struct(status.alias("indexStatusResult")).alias("inspectionResult"))).alias("payload"))
    return ingest.index_status(landed)[0].select("url", "coverage_state", "indexing_state", "page_fetch_state", "google_canonical", "user_canonical")


_FIELD = with_views("v_tech_audits") + ", a AS (SELECT url, lcp_ms, cls FROM v_tech_audits WHERE run_id = 1)"


@query(_FIELD + " SELECT url, CAST(lcp_ms AS DOUBLE) AS lcp_ms, CAST(NULL AS DOUBLE) AS inp_ms, cls FROM a WHERE lcp_ms % 3 <> 0 UNION ALL SELECT url, 1234.0, 50.0, 0.01 FROM a WHERE lcp_ms % 3 = 0")
def field_cwv_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the URLs have a record of their own, the others get their origin's."""
    rows = views.view(spark, sf_dir, "v_tech_audits").where("run_id = 1")
    p = lambda v: F.struct(F.struct(v.alias("p75")).alias("percentiles"))
    metrics = F.struct(p(F.col("lcp_ms")).alias("largest_contentful_paint"), p(F.col("cls").cast("string")).alias("cumulative_layout_shift"))
    own = rows.where("lcp_ms % 3 <> 0").select(*KEYS, "url", F.to_json(F.struct(F.struct(metrics.alias("metrics")).alias("record"))).alias("payload"))
    wide = F.struct(p(F.lit(1234)).alias("largest_contentful_paint"), p(F.lit(50)).alias("interaction_to_next_paint"), p(F.lit("0.01")).alias("cumulative_layout_shift"))
    origin = rows.select(*KEYS, F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1).alias("url")).distinct().withColumn("payload", F.to_json(F.struct(F.struct(wide.alias("metrics")).alias("record"))))
    out = ingest.with_origin_fallback(rows.select(*KEYS, "url"), ingest.field_cwv(own)[0], ingest.field_cwv(origin)[0])
    return out.select("url", "lcp_ms", "inp_ms", "cls")


def lab_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab audits as payloads with breakdown, shifts, page audits and issues; every nineteenth lacks its LCP."""
    rows = views.view(spark, sf_dir, "v_tech_audits").where("run_id = 1")
    payload = F.format_string(
        '{"finalDisplayedUrl":"%s","categories":{"performance":{"score":%.2f},"seo":{"score":null}},"audits":{"largest-contentful-paint":{"numericValue":%s},"cumulative-layout-shift":{"numericValue":%.2f},'
        '"lcp-breakdown-insight":{"details":{"items":[{"type":"table","items":[{"subpart":"timeToFirstByte","duration":%d},{"subpart":"elementRenderDelay","duration":%d}]},{"type":"node","selector":"main>h1.hero","snippet":"<h1>"}]}},'
        '"layout-shifts":{"details":{"items":[{"score":0.01,"node":{"type":"node","selector":"a"}},{"score":%.2f,"node":{"type":"node","selector":"b"}},{"score":%.2f,"node":{"type":"node","selector":"c"}}]}},'
        '"document-title":{"score":%d},"image-alt":{"score":0,"explanation":"no alt"},"render-blocking-insight":{"details":{"items":[{"url":"/a.css","totalBytes":%d}]}},"document-latency-insight":{"details":{"items":{"x":{"label":"redirects","value":false},"y":{"label":"ok","value":true}}}}}}',
        "url", F.col("cls"), F.when(F.col("lcp_ms") % 19 == 0, "null").otherwise(F.col("lcp_ms").cast("string")), "cls", "ttfb", "render_delay", "cls", "cls", (F.col("lcp_ms") % 2), "load_delay",
    )
    return rows.select(*KEYS, "url", payload.alias("payload"))


_LAB = with_views("v_tech_audits") + ", a AS (SELECT * FROM v_tech_audits WHERE run_id = 1 AND lcp_ms % 19 <> 0)"


@query(_LAB + " SELECT url, CAST(lcp_ms AS DOUBLE) AS lcp_ms, round(cls, 2) AS cls, CAST(floor(round(cls, 2) * 100 + 0.5) AS BIGINT) AS performance_score, CAST(ttfb AS DOUBLE) AS ttfb, CAST(render_delay AS DOUBLE) AS render_delay, 'main>h1.hero' AS target, CASE WHEN cls > 0.01 THEN 'b' ELSE 'a' END AS shift_target FROM a")
def ingest_lab_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.lab_audit(lab_payloads(spark, sf_dir))[0]
    return out.select("url", "lcp_ms", "cls", "performance_score", F.col("lcp.timeToFirstByte").alias("ttfb"), F.col("lcp.elementRenderDelay").alias("render_delay"), "lcp.target", F.col("shift.largestShiftTarget").alias("shift_target"))


@query(_LAB + " SELECT 'document-title' AS rule, url, 'high' AS severity, 'document-title' AS evidence FROM a WHERE lcp_ms % 2 = 0 UNION ALL SELECT 'image-alt', url, 'medium', 'no alt' FROM a")
def seo_audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.seo_findings(ingest.lab_audit(lab_payloads(spark, sf_dir))[0]).select("rule", "url", "severity", "evidence")


_SEO_NAMES = "['is-crawlable', 'document-title', 'meta-description', 'http-status-code', 'link-text', 'crawlable-anchors', 'robots-txt', 'image-alt', 'hreflang', 'canonical']"
_SEO_GRADES = "['critical', 'high', 'medium', 'critical', 'low', 'high', 'high', 'medium', 'medium', 'high']"


@query(with_views("v_tech_audits") + f""", x AS (SELECT run_id, url, lcp_ms + i AS n, {_SEO_NAMES}[i + 1] AS rule, {_SEO_GRADES}[i + 1] AS severity FROM v_tech_audits, range(10) AS r(i))
SELECT run_id, rule, url, severity, CASE n % 4 WHEN 0 THEN concat('told ', n) WHEN 1 THEN '2 elements' ELSE rule END AS evidence FROM x WHERE n % 3 = 0""")
def page_audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten page audits over two runs: scores 0, 1 or null, with an explanation, with elements, with an empty list, and alone."""
    rows = views.view(spark, sf_dir, "v_tech_audits")
    parts = []
    for i, name in enumerate(ingest.SEO_AUDITS):
        n = F.col("lcp_ms") + i
        score = F.when(n % 3 == 0, "0").when(n % 3 == 1, "1").otherwise("null")
        more = F.when(n % 4 == 0, F.concat(F.lit(',"explanation":"told '), n, F.lit('"'))).when(n % 4 == 1, ',"details":{"items":[{"url":"/a"},{"url":"/b"}]}').when(n % 4 == 2, ',"details":{"items":[]}').otherwise("")
        parts.append(F.concat(F.lit(f'"{name}":{{"score":'), score, more, F.lit("}")))
    head = F.format_string('{"finalDisplayedUrl":"%s","audits":{"largest-contentful-paint":{"numericValue":%d},"cumulative-layout-shift":{"numericValue":0},', "url", "lcp_ms")
    payloads = rows.select(*KEYS, F.concat(head, F.concat_ws(",", *parts), F.lit("}}")).alias("payload"))
    return ingest.seo_findings(ingest.lab_audit(payloads)[0]).select("run_id", "rule", "url", "severity", "evidence")


@query(_LAB + " SELECT url, 'render_blocking' AS kind, '/a.css' AS subject, CAST(load_delay AS DOUBLE) AS bytes FROM a UNION ALL SELECT url, 'latency', 'redirects', NULL FROM a")
def lab_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lab_issues(ingest.lab_audit(lab_payloads(spark, sf_dir))[0]).drop(*KEYS)


@query(with_views("v_ai_answers") + r" SELECT query, sample_index, conv_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 300) AS answer_excerpt FROM v_ai_answers WHERE conv_id % 9 <> 0 AND conv_id % 10 <> 0")
def ingest_ai_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in two parts; every ninth conversation is blocked, every tenth answers with an error."""
    rows = views.view(spark, sf_dir, "v_ai_answers")
    parts = F.array(F.struct(F.left("text", F.lit(20)).alias("text")), F.struct(F.substr(F.col("text"), F.lit(21)).alias("text")))
    payload = F.to_json(F.struct(
        F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"),
        F.when(F.col("conv_id") % 9 == 0, F.struct(F.lit("SAFETY").alias("blockReason"))).alias("promptFeedback"), F.when(F.col("conv_id") % 10 == 0, F.struct(F.lit("500").alias("status"))).alias("error"),
    ))
    landed = rows.select(*KEYS, F.concat_ws("#", "query", "conv_id").alias("query"), F.lit("m").alias("model"), "sample_index", payload.alias("payload"))
    out = ingest.ai_answers(landed)[0]
    return out.select(F.split_part("query", F.lit("#"), F.lit(1)).alias("query"), "sample_index", F.split_part("query", F.lit("#"), F.lit(2)).cast("long").alias("conv_id"), "text", "answer_excerpt")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'noindex' END AS x_robots_tag, 'text/html' AS content_type, CASE WHEN page_id % 2 = 0 THEN 'x-frame-options' ELSE '' END AS security_headers, 'de,en-GB' AS header_hreflangs FROM pages")
def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    common = [F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("x-robots-tag"), F.when(F.col("page_id") % 5 == 0, "  ").otherwise(" noindex"), F.lit("link"), F.lit('<https://a/>; rel="alternate"; hreflang="de", <https://b/>; rel=alternate; hreflang=en-GB, <https://c/>; rel=next')]
    headers = F.when(F.col("page_id") % 2 == 0, F.create_map(*common, F.lit("x-frame-options"), F.lit("DENY"))).otherwise(F.create_map(*common))
    got = html_pages.parse_headers(F.col("h"))
    return rows.select("page_id", headers.alias("h")).select("page_id", got["x_robots_tag"].alias("x_robots_tag"), got["content_type"].alias("content_type"), F.array_join(got["security_headers"], ",").alias("security_headers"), F.array_join(got["header_hreflangs"], ",").alias("header_hreflangs"))


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, url FROM pages")
def ingest_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    xml = rows.groupBy("host").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.collect_list("u"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit("\n</loc></url>"))), ""), F.lit("<loc></loc></urlset>")).alias("xml"))
    return html_pages.sitemap_urls(xml)


@query("SELECT url, NOT (contains(url, '/fr/') AND NOT contains(url, 'page=2')) AS allowed FROM (SELECT DISTINCT url FROM pages)")
def robots_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts forbid /fr/ but allow its addresses with page=2."""
    from pyspark.sql.functions import try_parse_url

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "url").distinct()
    text = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\n# notes\nDisallow: /*fr/\nAllow: /*fr/*page=2\n")
    rules = ingest.robots_rules(rows.select("host").distinct().withColumn("content", text))
    full = rows.withColumn("real", F.col("url")).withColumn("url", F.concat(F.lit("http://h"), try_parse_url("url", F.lit("PATH")), F.coalesce(F.replace(try_parse_url("url", F.lit("QUERY")), F.lit("?"), F.lit("")), F.lit(""))))
    return ingest.robots_allowed(full, rules).select(F.col("real").alias("url"), "allowed").distinct()


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN '301,302' ELSE '301' END AS statuses, CASE WHEN page_id % 3 = 0 AND page_id % 6 = 0 THEN url WHEN page_id % 3 = 0 THEN concat(url, '#2') ELSE concat(url, '#1') END AS final_url, page_id % 6 = 0 AS redirect_loop FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy("url").agg(F.min("page_id").alias("page_id")).withColumns({"client": F.lit(views.CLIENT), "run_id": F.lit(1)})
    first = rows.select(*KEYS, "url", F.lit(1).alias("hop"), F.col("url").alias("hop_url"), F.lit(301).alias("status_code"), F.concat("url", F.lit("#1")).alias("location"))
    second = rows.where("page_id % 3 = 0").select(*KEYS, "url", F.lit(2).alias("hop"), F.concat("url", F.lit("#1")).alias("hop_url"), F.lit(302).alias("status_code"), F.when(F.col("page_id") % 6 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#2"))).alias("location"))
    out = ingest.redirect_chains(first.unionByName(second))
    return out.select("url", F.array_join(F.transform("redirect_statuses", lambda s: s.cast("string")), ",").alias("statuses"), "final_url", "redirect_loop")


# -- source code

_FILES = with_views("v_source_files")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as source files of five clients, with the files that give a stack away."""
    rows = views.view(spark, sf_dir, "v_source_files").select(*KEYS, "rel_path", "content")
    marks = rows.select(*KEYS).distinct()
    nr = F.right("client", F.lit(1)).cast("int")
    names = F.when(nr % 3 == 0, F.array(F.lit("next.config.js"))).when(nr % 3 == 1, F.array(F.lit("index.php"), F.lit(".htaccess"))).otherwise(F.array(F.lit("wp-config.php")))
    text = F.when(F.col("rel_path") == ".htaccess", "RewriteRule ^(\\w+)$ /?lang=$1\n<FilesMatch css>\nExpiresActive On").otherwise("$db_password = 's3cretValue99';")
    made = marks.select(*KEYS, F.explode(names).alias("rel_path")).withColumn("content", text)
    return codeaudit.source_files(rows.unionByName(made).withColumn("length", F.length("content")), max_files=None)  # whole tables, no limit of an audit


@query(_FILES + " SELECT client, CASE CAST(right(client, 1) AS INTEGER) % 3 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'php-custom' ELSE 'wordpress' END AS stacks FROM v_source_files GROUP BY 1")
def detect_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeaudit.detect_stack(source_files(spark, sf_dir)).select("client", F.array_join("stacks", ",").alias("stacks"))


_CODE = _FILES + """, f AS (SELECT *, CAST(right(client, 1) AS INTEGER) % 3 AS stack FROM v_source_files),
hit AS (
  SELECT client, 'no_structured_data' AS rule, rel_path AS url FROM f WHERE stack > 0 AND regexp_matches(content, '<head[\\s>]') AND NOT regexp_matches(rel_path, '\\.html?$')
  UNION ALL SELECT client, 'no_https_rule', '.htaccess' FROM f WHERE stack = 1 GROUP BY client
  UNION ALL SELECT client, 'missing_metadata', rel_path FROM f WHERE stack = 0 AND regexp_matches(rel_path, '(^|/)page\\.tsx?$')
  UNION ALL SELECT client, 'raw_script', rel_path FROM f WHERE stack = 0 AND regexp_matches(content, '<script')
  UNION ALL SELECT client, 'missing_hreflang_source', NULL FROM f WHERE stack = 1 GROUP BY client
  UNION ALL SELECT client, 'no_canonical_convention', NULL FROM f WHERE stack = 0 AND regexp_matches(rel_path, '(^|/)page\\.tsx?$') GROUP BY client
  UNION ALL SELECT client, 'no_robots_sitemap_file', NULL FROM f WHERE stack = 0 AND regexp_matches(rel_path, '(^|/)app/') GROUP BY client
  UNION ALL SELECT client, 'public_dead_html', NULL FROM f WHERE regexp_matches(rel_path, '\\.html?$') GROUP BY client)"""


@query(_CODE + " SELECT client, rule, url FROM hit")
def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir)
    stacks = codeaudit.detect_stack(files)
    return codeaudit.file_findings(files, stacks).unionByName(codeaudit.project_findings(files, stacks)).select("client", "rule", "url")


@query(_FILES + """, l AS (SELECT client, rel_path, regexp_extract_all(content, '(?s)^(.*?)(?:class(?:Name)?|id)="[^"]*\\bad\\b', 1)[1] AS before FROM v_source_files)
SELECT client, rel_path AS code_file, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS code_line FROM l WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client ORDER BY rel_path) = 1""")
def link_findings_to_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir)
    made = files.select(*KEYS).distinct().withColumn("culprit_selector", F.lit("main > div.ad"))
    return codeaudit.link_findings(made, files).where("code_file is not null").select("client", "code_file", "code_line")


_COMPONENTS = with_views("v_components")
# what each kind of component shows; lines: two of the head, two of the main tag, then the markup, then the page
_COMPONENT_HITS = _COMPONENTS + r""", c AS (SELECT *, page_id % 8 AS kind, strpos(html_, '<script') > 0 AS scripts,
    5 + length(split_part(html_, '<script', 1)) - length(replace(split_part(html_, '<script', 1), chr(10), '')) AS script_line
  FROM (SELECT v.*, p.html AS html_ FROM v_components v JOIN pages p USING (page_id))),
hit AS (
  SELECT client, 'legacy_images' AS rule, rel_path AS code_file, CAST(NULL AS INTEGER) AS code_line, CASE kind WHEN 1 THEN 'low' ELSE 'medium' END AS severity, CASE kind WHEN 1 THEN '0/1' ELSE '1/1' END AS evidence FROM c WHERE kind IN (0, 1, 6)
  UNION ALL SELECT client, 'raw_img', rel_path, 4 + 1, 'medium', '' FROM c WHERE kind IN (0, 1, 5, 6)
  UNION ALL SELECT client, 'third_party_scripts', rel_path, NULL, 'high', '1/1' FROM c WHERE kind = 2
  UNION ALL SELECT client, 'image_without_priority', rel_path, NULL, 'low', '' FROM c WHERE kind = 3
  UNION ALL SELECT client, 'raw_script', rel_path, CASE WHEN kind = 2 THEN 5 ELSE script_line + 1 END, 'low', '' FROM c WHERE kind = 2 OR scripts)"""


def _component_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.view(spark, sf_dir, "v_components").select(*KEYS, "rel_path", "content")
    stacks = files.select(*KEYS).distinct().withColumn("stacks", F.array(F.lit("nextjs")))
    return codeaudit.file_findings(files, stacks)


@query(_COMPONENT_HITS + " SELECT client, rule, code_file, code_line, severity, evidence FROM hit")
def component_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over JSX with nested braces, template literals, tags in attributes and values over several lines, with their places."""
    return _component_findings(spark, sf_dir).select("client", "rule", "code_file", "code_line", "severity", "evidence")


@query(_COMPONENT_HITS + """ SELECT client, code_file, count(*) AS n_findings, min(list_position(['critical', 'high', 'medium', 'low'], severity)) AS worst,
  string_agg(rule || ':' || coalesce(CAST(code_line AS VARCHAR), ''), ',' ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), rule) AS listing FROM hit GROUP BY client, code_file""")
def code_findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = codeaudit.by_file(_component_findings(spark, sf_dir))
    listing = F.array_join(F.transform("listing", lambda x: F.concat(x["rule"], F.lit(":"), F.coalesce(x["line"].cast("string"), F.lit("")))), ",")
    return out.select("client", "code_file", "n_findings", "worst", listing.alias("listing"))


@query(_COMPONENTS + """, t AS (SELECT client, unnest([CAST(page_id % 4 AS VARCHAR), CAST(page_id % 7 AS VARCHAR)]) AS n, unnest(['shell-', 'wide-card-']) AS stem, rel_path FROM v_components)
SELECT client, '.' || stem || n AS culprit_selector, min(rel_path) AS code_file, CAST(3 AS INTEGER) AS code_line FROM t GROUP BY client, stem, n
UNION ALL SELECT client, '.card', min(rel_path), CAST(3 AS INTEGER) FROM v_components GROUP BY client""")
def selector_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selector of the components, placed by phrases of the positional index; the attribute starts a line before some of its words."""
    files = views.view(spark, sf_dir, "v_components")
    own = F.array(F.lit(".card"), F.concat(F.lit("main > div.shell-"), F.col("page_id") % 4), F.concat(F.lit("main.wide-card-"), F.col("page_id") % 7))
    made = files.select(*KEYS, F.explode(own).alias("culprit_selector")).distinct()
    out = codeaudit.link_findings(made, files.select(*KEYS, "rel_path", "content"))
    return out.select("client", F.concat(F.lit("."), F.substring_index("culprit_selector", ".", -1)).alias("culprit_selector"), "code_file", "code_line")


@query(_FILES + " SELECT client, count(*) AS files, CAST(0 AS BIGINT) AS leaked FROM v_source_files WHERE rel_path LIKE '%.php' GROUP BY client")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that is a PHP file gets a line with a secret of its own behind its content."""
    line = F.concat(F.lit("\n$db_password = 's3cret"), F.xxhash64("rel_path").cast("string"), F.lit("';"))
    rows = views.view(spark, sf_dir, "v_source_files").where("rel_path like '%.php'").withColumn("content", F.concat("content", line))
    done = rows.select("client", codeaudit.redact(F.col("content")).alias("content"))
    return done.groupBy("client").agg(F.count_if(F.col("content").contains(codeaudit.REDACTED)).alias("files"), F.count_if(F.col("content").contains("'s3cret")).alias("leaked"))


# -- folders of source code

# the pages as files and, by number, files whose names, folders or sizes decide: dot-files, ignored folders at any depth, kinds, the limit of bytes
_TREE = with_views("v_source_files", "v_more_files") + """,
tree AS (SELECT client, rel_path, content FROM v_source_files UNION ALL SELECT client, rel_path, content FROM v_more_files),
listed AS (SELECT *, strlen(content) AS n_bytes FROM tree WHERE regexp_matches(lower(rel_path), '[^/]\\.(php|tsx|html|css|json)$|/\\.htaccess$') AND NOT regexp_matches(rel_path, '(^|/)(vendor|\\.git|\\.next|node_modules)/'))"""


def source_tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of five clients landed in the shared folder and listed there."""
    rows = views.view(spark, sf_dir, "v_source_files").select("client", "rel_path", "content")
    rows = rows.unionByName(views.view(spark, sf_dir, "v_more_files").select("client", "rel_path", "content"))
    root = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    source_tree.land(rows, root)
    return codeaudit.scan(spark, {f"client{i}": f"{root}/client{i}" for i in range(5)})


@query(_TREE + " SELECT client, rel_path, n_bytes, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS line_count, md5(content) AS digest FROM listed WHERE n_bytes <= 300000")
def scan_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that an audit may read, opened; contents hold no names of secrets, so redaction leaves them as they are."""
    out = codeaudit.read_files(source_tree_listing(spark, sf_dir), max_files=None)
    return out.select("client", "rel_path", F.octet_length("content").cast("long").alias("n_bytes"), "line_count", F.md5("content").alias("digest"))


@query(_TREE + " SELECT client, least(count(*) FILTER (WHERE n_bytes <= 300000), 15) AS files, count(*) FILTER (WHERE n_bytes > 300000) AS oversized, count(*) FILTER (WHERE n_bytes <= 300000) > 15 AS truncated FROM listed GROUP BY client")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an audit that reads 15 files a client; no file is opened."""
    return codeaudit.scan_counters(source_tree_listing(spark, sf_dir), max_files=15).select("client", "files", "oversized", "truncated")


# -- marts


@query(with_views("v_serp") + "," + _COMPETITORS + """
SELECT 'client.com' AS client, 1 AS run_id, (SELECT count(DISTINCT kw_id) FROM v_serp) AS keywords, count(*) AS real_competitors FROM competitor WHERE is_real_competitor""")
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ai

    out = marts.headline(keyword_rows(spark, sf_dir), _competitors(spark, sf_dir), ai.visibility(_samples(spark, sf_dir), _rivals(spark)), _rank_changes(spark, sf_dir).withColumn("run_id", F.lit(1)))
    return out.select("client", "run_id", "keywords", "real_competitors")


@query(with_views("v_tech_audits") + " SELECT run_id, url, true AS is_client, lcp_ms <= 2500 AS passes_lcp, inp_ms <= 200 AS passes_inp, cls <= 0.1 AS passes_cls FROM v_tech_audits")
def tech_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.tech_evaluation(audits(spark, sf_dir)).drop("client")


_SINGLE = _PAGES + r""", p1 AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') ORDER BY length(url), page_id) = 1),
f AS (""" + _ON_PAGE.replace(" FROM p WHERE", " FROM p1 WHERE") + ")"


@query(_SINGLE + " SELECT url, count(*) AS n_findings, max(impact) AS impact, min(list_position(['critical', 'high', 'medium', 'low'], severity)) AS worst FROM f GROUP BY url")
def single_page_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-page findings of the shallowest page of every host, as for a list of single pages."""
    from ..functions.urls import url_host
    from ..operators import audit
    from ..operators.keys import first_by

    rows = pages(spark, sf_dir).withColumn("host", url_host(F.col("url")))
    return findings.url_totals(audit.on_page(first_by(rows, [*KEYS, "host"], [F.length("url").asc(), F.asc("page_id")]))).drop(*KEYS)
