"""Search-visibility tables as views over the given tables: SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
CLIENT = "client.com"
SEEDS = ("absent-rival.com",)
BRANDS = ("brand#2",)
AI_BRANDS = ("ation",)
AI_COMPETITORS = ("ment.com", "erin.com", "thand.com")

VIEWS: dict[str, str] = {
    "v_serp": """
WITH x AS (
  SELECT l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS position
  FROM lineitem)
SELECT x.l_partkey AS kw_id,
       concat(p_name, ' ', CAST(p_partkey AS STRING), ' ',
         CASE p_size % 6 WHEN 0 THEN 'FİYATLARI' WHEN 1 THEN 'nasıl yapılır' WHEN 2 THEN 'İSTANBUL'
                         WHEN 3 THEN 'Brand#2' WHEN 4 THEN 'ISITICI' ELSE '' END) AS keyword,
       position,
       CASE x.l_suppkey % 20 WHEN 0 THEN 'client.com' WHEN 1 THEN 'trendyol.com' WHEN 2 THEN 'shop.n11.com' WHEN 3 THEN 'onedio.com'
         WHEN 4 THEN 'rival-a.com' WHEN 5 THEN 'rival-b.com' ELSE concat('s', CAST(x.l_suppkey AS STRING), '.com') END AS domain,
       concat('https://www.s', CAST(x.l_suppkey AS STRING), '.com/p/', CAST(x.l_partkey AS STRING)) AS url,
       p_size % 2 = 0 AS has_featured_snippet, p_size % 3 = 0 AS has_ai_overview
FROM x JOIN part ON p_partkey = x.l_partkey WHERE position <= 10""",
    "v_serp_prev": """
SELECT kw_id, keyword, position + kw_id % 3 AS position, domain, url, has_featured_snippet, has_ai_overview
FROM v_serp WHERE position + kw_id % 3 <= 10 AND kw_id % 50 <> 0""",
    "v_keywords": """
SELECT p_partkey AS kw_id, CAST(floor(p_retailprice * 20) AS BIGINT) AS volume, p_size / CAST(60 AS DOUBLE) AS difficulty, p_size / CAST(10 AS DOUBLE) AS cpc FROM part""",
    "v_search_performance": """
SELECT concat('q', CAST(l_partkey % 300 AS STRING)) AS query,
       CASE WHEN l_suppkey % 9 = 8 THEN '' ELSE concat('/p', CAST(l_suppkey % 9 AS STRING)) END AS page,
       count(*) AS clicks, CAST(sum(floor(l_quantity)) AS BIGINT) AS impressions
FROM lineitem GROUP BY 1, 2""",
    "v_rum_samples": """
SELECT event_id, ts AS received_at, concat('https://client.com/u', CAST(user_id AS STRING), '/', CAST(event_id % 3 AS STRING)) AS url,
  CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'error' THEN 'CLS' WHEN 'signup' THEN 'TTFB' ELSE 'OTHER' END AS metric,
  CASE event_type WHEN 'view' THEN value * 12 WHEN 'click' THEN value * 2 WHEN 'error' THEN value / 1000 ELSE value * 6 END AS value
FROM events""",
    "v_ai_answers": """
SELECT concat('query ', CAST(conv_id % 20 AS STRING)) AS query, conv_id, turn AS sample_index, text
FROM conversations WHERE role = 'assistant'""",
    "v_client_answers": """
SELECT concat('client', CAST(conv_id % 25 AS STRING)) AS client, conv_id, turn AS sample_index, text FROM conversations WHERE role = 'assistant'""",
    # lists of each nation's own: client 3 has no rivals, client 4 no names at all, every fifth one a brand without letters
    "v_client_brands": """
SELECT concat('client', CAST(n_nationkey AS STRING)) AS client,
  CASE n_nationkey % 5 WHEN 0 THEN 'ation' WHEN 1 THEN 'Keit En' WHEN 2 THEN 'İNG' WHEN 3 THEN 'th-e' ELSE '---' END AS token FROM nation WHERE n_nationkey <> 4""",
    "v_client_rivals": """
SELECT concat('client', CAST(n_nationkey AS STRING)) AS client, domain
FROM nation CROSS JOIN (VALUES (0, 'ment.com'), (1, 'erin.com.tr'), (2, 'ung-en.de'), (3, 'tr.io'), (4, 'ÖUN.fr'), (5, 'thand.com'), (6, 'absent.com')) AS d(nr, domain)
WHERE (n_nationkey + nr) % 3 <> 0 AND n_nationkey NOT IN (3, 4)""",
    "v_index_status": """
SELECT concat('https://client.com/o/', CAST(o_orderkey AS STRING)) AS url,
  CASE o_orderstatus WHEN 'F' THEN 'BLOCKED_BY_META_TAG' WHEN 'O' THEN 'INDEXING_ALLOWED' ELSE 'INDEXING_STATE_UNSPECIFIED' END AS indexing_state,
  CASE WHEN o_custkey % 13 = 0 THEN 'NOT_FOUND' ELSE 'SUCCESSFUL' END AS page_fetch_state,
  concat('https://client.com/o/', CAST(o_orderkey AS STRING)) AS user_canonical,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 'https://client.com/' ELSE concat('https://client.com/o/', CAST(o_orderkey AS STRING)) END AS google_canonical
FROM orders""",
    "v_tech_audits": """
SELECT o_orderkey % 2 AS run_id, concat('https://client.com/o/', CAST(o_custkey AS STRING)) AS url,
  max(CAST(floor(o_totalprice) AS BIGINT) % 6000) AS lcp_ms, max(CAST(floor(o_totalprice) AS BIGINT) % 700) AS inp_ms,
  max(CAST(floor(o_totalprice) AS BIGINT) % 40) / CAST(100 AS DOUBLE) AS cls,
  max(CAST(floor(o_totalprice) AS BIGINT) % 1500) AS ttfb, max(CAST(floor(o_totalprice) AS BIGINT) % 900) AS load_delay,
  max(CAST(floor(o_totalprice) AS BIGINT) % 2100) AS load_duration, max(CAST(floor(o_totalprice) AS BIGINT) % 800) AS render_delay,
  max(CAST(floor(o_totalprice) AS BIGINT) % 5000) AS largest_shift_time
FROM orders GROUP BY 1, 2""",
    "v_page_links": """
SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS source_id, CAST(l_partkey AS BIGINT) AS target_id FROM lineitem""",
    "v_crawl": """
SELECT page_id, url, html,
  CASE WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN page_id % 17 = 0 THEN 'timeout' END AS fetch_error,
  CASE WHEN page_id % 3 = 0 THEN next_url WHEN page_id % 3 = 1 THEN url END AS canonical_url,
  CASE WHEN page_id % 10 = 0 THEN 'noindex,follow' END AS meta_robots,
  CASE WHEN page_id % 23 = 0 THEN 'noindex' END AS x_robots_tag,
  page_id % 4 <> 0 AS in_sitemap, page_id % 6 AS depth,
  CASE WHEN page_id % 13 = 0 THEN next_url ELSE url END AS final_url,
  CASE WHEN page_id % 13 = 0 THEN '301' WHEN page_id % 7 = 0 THEN '301,302' ELSE '' END AS hops, page_id % 29 = 0 AS redirect_loop,
  CASE WHEN page_id % 31 = 0 THEN 'application/pdf' WHEN page_id % 2 = 0 THEN 'text/html' END AS content_type
FROM pages LEFT JOIN (SELECT page_id - 1 AS before_id, url AS next_url FROM pages) n ON before_id = page_id""",
    "v_source_files": """
SELECT concat('client', CAST(page_id % 5 AS STRING)) AS client,
  concat(CASE page_id % 4 WHEN 0 THEN 'template/' WHEN 1 THEN 'app/' ELSE 'inc/' END, 'f', CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '/page.tsx' ELSE '.php' END) AS rel_path,
  html AS content FROM pages""",
    "v_more_files": """
SELECT concat('client', CAST(page_id % 5 AS STRING)) AS client, concat('d', CAST(page_id AS STRING),
    CASE page_id % 12 WHEN 0 THEN '/.htaccess' WHEN 1 THEN '/vendor/a.php' WHEN 2 THEN '/.git/a.json' WHEN 3 THEN '/app/.next/deep/a.css' WHEN 4 THEN '/a.md' WHEN 5 THEN '/big/a.CSS'
      WHEN 6 THEN '/big/just.css' WHEN 7 THEN '/A.JSON' WHEN 8 THEN '/.json' WHEN 9 THEN '/vendors/a.b.php' WHEN 10 THEN '/node_modules/x/y/a.html' ELSE '/php' END) AS rel_path,
  CASE WHEN page_id % 12 IN (5, 6) THEN repeat('abcd' || chr(10), CASE WHEN page_id % 12 = 5 THEN 60001 ELSE 60000 END) ELSE concat('ğ ', CAST(page_id AS STRING), chr(10)) END AS content
FROM pages""",
    # each page's HTML in a component of its own, behind markup with braces, template literals and values over several lines
    "v_components": """
SELECT concat('client', CAST(page_id % 3 AS STRING)) AS client, concat('app/p', CAST(page_id AS STRING), '/page.tsx') AS rel_path, page_id,
  concat('export const metadata = {}', chr(10), 'export default function P() { return <main', chr(10), '  className="wrap shell-', CAST(page_id % 4 AS STRING), chr(10), '    wide-card-', CAST(page_id % 7 AS STRING), '">', chr(10),
    CASE page_id % 8 WHEN 0 THEN '<img src="/a.png" style={{width: 10}} />' WHEN 1 THEN '<img alt={`${t > 1 ? "a" : `b${n}`}`} src="/b.jpg" loading="lazy" />'
      WHEN 2 THEN '<script src="https://cdn.example/x.js" onLoad={() => { f("}") }}></script>' WHEN 3 THEN '<Image src="/c.png" style={{color: "}"}} />'
      WHEN 4 THEN '<Image priority src="/d.png" onClick={() => go({a: 1})} />' WHEN 5 THEN '<img srcSet={`${a} 1x`} src="/e.jpeg" data-alt="/e.webp" />'
      WHEN 6 THEN '<Card icon={<img src="/f.jpg"/>} async />' ELSE '<script type="application/ld+json" dangerouslySetInnerHTML={{__html: s}} />' END,
    chr(10), html, '</main> }') AS content FROM pages""",
}

# facts of five clients and six runs; the fourth run of clients 1 and 4 failed, client 2 has a run that still goes on
_AT = "concat('client', CAST({of} % 5 AS STRING)) AS client, 1 + {run} % 6 AS run_id"
VIEWS |= {
    "v_run_states": """
SELECT DISTINCT concat('client', CAST(o_custkey % 5 AS STRING)) AS client, 1 + o_orderkey % 6 AS run_id,
  CASE WHEN o_orderkey % 6 = 3 AND o_custkey % 5 IN (1, 4) THEN 'failed' WHEN o_orderkey % 6 = 5 AND o_custkey % 5 = 2 THEN 'running' ELSE 'completed' END AS status,
  concat('h', CAST((o_custkey % 5) * (o_orderkey % 6) % 4 AS STRING)) AS config_hash FROM orders""",
    "v_run_keywords": f"""
SELECT {_AT.format(of="l_suppkey", run="l_orderkey")}, CAST(l_partkey AS BIGINT) AS keyword, CAST(CASE WHEN min(l_quantity) <= 10 THEN min(l_quantity) END AS INT) AS client_rank FROM lineitem GROUP BY 1, 2, 3""",
    "v_run_competitors": f"""
SELECT {_AT.format(of="l_suppkey", run="l_orderkey")}, concat('s', CAST(l_partkey % 97 AS STRING), '.com') AS domain, count(*) % 3 <> 0 AS is_real_competitor FROM lineitem GROUP BY 1, 2, 3""",
    "v_run_audits": f"""
SELECT {_AT.format(of="o_custkey", run="o_orderkey")}, concat('/o/', CAST(o_custkey AS STRING)) AS url, CAST(max(CAST(floor(o_totalprice) AS BIGINT) % 6000) AS DOUBLE) AS lcp_ms,
  CAST(max(CAST(floor(o_totalprice) AS BIGINT) % 700) AS DOUBLE) AS inp_ms, max(CAST(floor(o_totalprice) AS BIGINT) % 40) / CAST(100 AS DOUBLE) AS cls FROM orders GROUP BY 1, 2, 3""",
    "v_run_samples": f"""
SELECT {_AT.format(of="o_custkey", run="o_orderkey")}, concat('query ', CAST(o_custkey % 30 AS STRING)) AS query, CAST(floor(o_totalprice) AS BIGINT) % 3 = 0 AS client_mentioned FROM orders""",
    "v_run_pages": f"""
SELECT {_AT.format(of="page_id", run="CAST(floor(page_id / CAST(5 AS DOUBLE)) AS BIGINT)")}, url FROM pages""",
    "v_run_findings": f"""
SELECT {_AT.format(of="l_suppkey", run="l_orderkey")}, CASE l_linenumber % 2 WHEN 0 THEN 'onpage' ELSE 'links' END AS category,
  concat(CASE l_returnflag WHEN 'R' THEN 'images without alt (' WHEN 'A' THEN 'long title (' ELSE 'broken link (' END, CAST(l_linenumber AS STRING), ')') AS title,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('/p/', CAST(l_partkey AS STRING)) END AS url FROM lineitem""",
}

USES = {"v_serp_prev": ("v_serp",)}


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


_held: ContextVar[dict[str, DataFrame]] = ContextVar("held", default={})


@contextmanager
def held(spark: SparkSession, sf_dir: str, *names: str) -> Iterator[None]:
    """Within it the views named are written once, and all that ask for them read what was written."""
    before = _held.set(_held.get())
    try:
        for name in names:
            tables(spark, sf_dir)
            _held.set(_held.get() | {name: stored(_rows(spark, name), name)})
        yield
    finally:
        _held.reset(before)


def _rows(spark: SparkSession, name: str) -> DataFrame:
    if name in _held.get():
        return _held.get()[name]
    for other in USES.get(name, ()):
        _rows(spark, other).createOrReplaceTempView(other)
    return spark.sql(VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows with the keys that every operator carries: one client, one run unless the view has runs."""
    tables(spark, sf_dir)
    rows = _rows(spark, name)
    for column, value in (("client", CLIENT), ("run_id", 1)):
        if column not in rows.columns:
            rows = rows.selectExpr("*", f"{value!r} AS {column}")
    return rows


def with_views(*names: str) -> str:
    """The views as the beginning of a WITH clause for DuckDB."""
    order = dict.fromkeys(n for name in names for n in (*USES.get(name, ()), name))
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
