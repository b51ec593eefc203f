"""Queries of the site audit, web vitals and click depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tr_normalize
from ..operators import audit, findings, graph, keywords, search, vitals
from ..operators.keys import KEYS
from ..sources import html_pages, ingest
from ..sources.shared import stored
from . import views
from .keyword_queries import _norm, keyword_rows, serps
from .registry import query
from .views import with_views

FINDING = ("rule", "category", "severity", "url", "evidence", "impact")
FIRST_TEXT = 20_000


def pages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Crawled pages with the fields of their HTML and the crawl's own columns; with their ``whole`` texts, or with the first
    ``FIRST_TEXT`` characters and the words in them, by which the SQL of the other queries judges a page."""
    raw = views.view(spark, sf_dir, "v_crawl").withColumn("html_length", F.length("html"))
    out = html_pages.extract(raw)
    if not whole:
        out = out.withColumn("body_text", F.left("body_text", F.lit(FIRST_TEXT))).withColumn("word_count", html_pages.words(F.col("body_text")))
    none = F.array().cast("array<string>")
    return out.withColumns({
        "seq": F.col("page_id"), "is_client_rendered": html_pages.client_rendered(F.col("html_length")),
        "schema_types": F.transform("schema_blocks", lambda b: b["type"]), "header_hreflangs": none,
        "redirect_statuses": F.transform(F.filter(F.split("hops", ","), lambda h: h != ""), lambda h: h.cast("int")),
    })


def stored_pages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The pages with the fields of their HTML, parsed once and written, for rules that read them from several sides."""
    return stored(pages(spark, sf_dir, whole), "pages")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the crawl itself knows of the pages, for rules that need nothing of the HTML; the scan leaves it out."""
    statuses = F.transform(F.filter(F.split("hops", ","), lambda h: h != ""), lambda h: h.cast("int"))
    return views.view(spark, sf_dir, "v_crawl").drop("html").withColumns({"seq": F.col("page_id"), "redirect_statuses": statuses})


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, "v_crawl").where("in_sitemap").select(*KEYS, "url")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored page links, put on the crawl's URLs by number."""
    named = views.view(spark, sf_dir, "v_crawl").select("page_id", "url")
    rows = views.view(spark, sf_dir, "v_page_links")
    source = named.select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"), F.col("page_id").alias("seq"))
    target = named.select(F.col("page_id").alias("target_id"), F.col("url").alias("target_url"))
    return rows.join(source, "source_id").join(target, "target_id").select(*KEYS, "seq", "source_url", "target_url")


def _text(x: str) -> str:
    """Entities decoded as HTML decodes them: these names count without their semicolon too, a number ends where its digits end."""
    for entity, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&#39([^0-9]|$)", r"''\1"), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return x


_STRIPPED = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"
_WHOLE = f"trim(regexp_replace({_text(_STRIPPED)}, '\\s+', ' ', 'g'))"
_BODY = f"left({_WHOLE}, {FIRST_TEXT})"
_PAGES = with_views("v_crawl") + f""",
p AS (
  SELECT *, nullif(trim({_text("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")}), '') AS title,
    list_transform(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), lambda h: trim({_text("regexp_replace(h, '<[^>]*>', '', 'g')")})) AS h1s,
    nullif(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1), '') AS lang, {_BODY} AS body_text,
    CASE WHEN {_BODY} = '' THEN 0 ELSE len(string_split_regex({_BODY}, '\\s+')) END AS word_count,
    regexp_matches(coalesce(meta_robots, ''), 'noindex') OR regexp_matches(coalesce(x_robots_tag, ''), 'noindex') AS noindex,
    coalesce(status_code BETWEEN 200 AND 299, false) AS ok
  FROM v_crawl)"""


def whole_texts(sql: str) -> str:
    """The SQL over whole texts of pages, not their first characters."""
    return sql.replace(_BODY, _WHOLE)


def _rule(rule: str, severity: str, cond: str, evidence: str, category: str = "onpage", source: str = "p", url: str = "url", page: str = "page_id") -> str:
    """``page`` numbers the page that the finding is of, -1 where it is of none: two pages may have one URL."""
    impact = {"critical": 70, "high": 45, "medium": 25, "low": 10}[severity]
    return f"SELECT '{rule}' AS rule, '{category}' AS category, '{severity}' AS severity, {url} AS url, {evidence} AS evidence, {impact} AS impact, {page} AS page FROM {source} WHERE {cond}"


def _union(*rules: str) -> str:
    return " UNION ALL ".join(rules)


TOLD = "SELECT rule, category, severity, url, evidence, impact FROM ("


def _told(*rules: str) -> str:
    return f" {TOLD}{_union(*rules)})"


def with_page(sql: str) -> str:
    """The SQL of a family of findings with the number of each finding's page."""
    return sql.replace(TOLD, TOLD.replace("impact FROM", "impact, page FROM"))


@query(whole_texts(_PAGES) + " SELECT page_id, title, lang, len(h1s) AS n_h1, array_to_string(h1s, '|') AS h1, word_count, md5(body_text) AS body_md5 FROM p")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages(spark, sf_dir, whole=True)
    return out.select("page_id", "title", "lang", F.size("h1s").cast("long").alias("n_h1"), F.array_join("h1s", "|").alias("h1"), F.col("word_count").cast("long").alias("word_count"), F.md5(F.col("body_text").cast("binary")).alias("body_md5"))


@query("""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, min(CASE WHEN starts_with(href, 'http') THEN href ELSE concat(regexp_extract(url, '^([a-z]+://[^/]+)', 1), href) END) AS first_target
FROM a WHERE starts_with(href, '/') OR starts_with(href, regexp_extract(url, '^([a-z]+://[^/]+)', 1)) GROUP BY page_id""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages(spark, sf_dir).select("page_id", F.explode("links").alias("l"))
    return out.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("l.target_url").alias("first_target"))


_ON_PAGE = _union(
    _rule("missing_title", "critical", "ok AND title IS NULL", "''"),
    _rule("title_too_long", "low", "ok AND length(title) > 60", "CAST(length(title) AS VARCHAR)"),
    _rule("meta_description_missing", "medium", "ok", "''"),
    _rule("missing_h1", "high", "ok AND len(h1s) = 0", "''"),
    _rule("multiple_h1", "medium", "ok AND len(h1s) > 1", "CAST(len(h1s) AS VARCHAR)"),
    _rule("missing_canonical", "medium", "ok AND canonical_url IS NULL", "''"),
    _rule("missing_schema", "low", "ok", "''"),
    _rule("incomplete_og", "low", "ok", "''"),
    _rule("deep_page", "medium", "ok AND depth > 3", "CAST(depth AS VARCHAR)"),
    _rule("thin_content", "medium", "ok AND word_count < 150", "CAST(word_count AS VARCHAR)"),
    _rule("missing_viewport", "high", "ok", "''"),
    _rule("missing_lang", "low", "ok AND lang IS NULL", "''"),
)


@query(_PAGES + _told(_ON_PAGE))
def on_page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.on_page(pages(spark, sf_dir)).select(*FINDING)


_DUPES = """,
t AS (SELECT page_id, url, title AS k, count(*) OVER (PARTITION BY title) AS n FROM p WHERE ok AND title IS NOT NULL),
h AS (SELECT page_id, url, h1s[1] AS k, count(*) OVER (PARTITION BY h1s[1]) AS n FROM p WHERE ok AND h1s[1] <> '')"""


@query(_PAGES + _DUPES + _told(_rule("duplicate_title", "medium", "n > 1", "concat(n, ' ', k)", source="t"), _rule("duplicate_h1", "low", "n > 1", "concat(n, ' ', k)", source="h")))
def duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored_pages(spark, sf_dir)
    return audit.duplicate_titles(p).unionByName(audit.duplicate_h1s(p)).select(*FINDING)


_SITE = ", s AS (SELECT count(DISTINCT nullif(lower(regexp_extract(url, '^[a-z]+://[^/]+/+([A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:/|$)', 1)), '')) AS n FROM p WHERE ok)"


@query(_PAGES + _SITE + _told(_rule("missing_hreflang_site", "medium", "n >= 2", "CAST(n AS VARCHAR)", source="s", url="CAST(NULL AS VARCHAR)", page="-1")))
def missing_hreflang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_hreflang(pages(spark, sf_dir)).select(*FINDING)


_ALIASED = """,
named AS (SELECT *, url AS alias FROM p UNION ALL SELECT *, final_url FROM p WHERE final_url IS NOT NULL AND final_url <> url),
alias AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY page_id DESC) AS rn FROM named) WHERE rn = 1)"""
_EDGES = """,
edge AS (SELECT a.page_id, a.url AS source_url, b.url AS target_url FROM v_page_links l JOIN p a ON a.page_id = source_id JOIN p b ON b.page_id = target_id),
broken AS (SELECT e.*, coalesce(fetch_error, CAST(status_code AS VARCHAR)) AS why FROM edge e JOIN alias ON alias = target_url WHERE fetch_error IS NOT NULL OR status_code >= 400),
moved AS (SELECT e.*, final_url FROM edge e JOIN p ON p.url = target_url AND final_url <> url),
alone AS (SELECT page_id, url FROM p WHERE ok AND url NOT IN (SELECT target_url FROM edge) AND final_url NOT IN (SELECT target_url FROM edge) AND url NOT IN (SELECT url FROM p WHERE page_id = 0))"""


@query(_PAGES.replace("WITH ", with_views("v_page_links") + ", ", 1) + _ALIASED + _EDGES + _told(
    _rule("broken_link", "high", "true", "concat(target_url, ' ', why)", "links", "broken", "source_url"),
    _rule("link_to_redirect", "low", "true", "concat(target_url, ' ', final_url)", "links", "moved", "source_url"),
    _rule("orphan_page", "medium", "true", "''", "links", "alone"),
))
def link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = crawl(spark, sf_dir)
    return audit.links(p, edges(spark, sf_dir), p.where("page_id = 0").select(*KEYS, "url")).select(*FINDING)


@query(_PAGES + _told(
    _rule("redirect_chain", "medium", "hops = '301,302'", "'2'", "links"),
    _rule("redirect_loop", "critical", "redirect_loop", "''", "links"),
    _rule("temp_redirect_in_sitemap", "low", "url IN (SELECT url FROM p WHERE in_sitemap) AND contains(hops, '302')", "''", "links"),
))
def redirect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.redirects(crawl(spark, sf_dir), sitemap(spark, sf_dir)).select(*FINDING)


_LISTS = """,
site AS (SELECT DISTINCT url FROM p WHERE in_sitemap),
seen AS (SELECT url FROM p UNION SELECT final_url FROM p),
unseen AS (SELECT url FROM site WHERE url NOT IN (SELECT url FROM seen)),
unlisted AS (SELECT url FROM p WHERE ok AND url NOT IN (SELECT url FROM site)),
l1 AS (SELECT count(*) AS n, array_to_string(list_sort(list(url))[1:5], ', ') AS shown FROM unseen HAVING count(*) > 0),
l2 AS (SELECT count(*) AS n, array_to_string(list_sort(list(url))[1:5], ', ') AS shown FROM unlisted HAVING count(*) > 0)"""
_SHOWN = "concat(n, ': ', shown, CASE WHEN n > 5 THEN concat(' (+', n - 5, ')') ELSE '' END)"


@query(_PAGES + _LISTS + _told(
    _rule("http_noindex", "critical", "x_robots_tag = 'noindex'", "x_robots_tag", "indexing"),
    _rule("content_type_not_html", "low", "NOT contains(content_type, 'html')", "content_type", "indexing"),
    _rule("noindex_in_sitemap", "high", "noindex AND (url IN (SELECT url FROM site) OR final_url IN (SELECT url FROM site))", "''", "indexing"),
    _rule("sitemap_not_crawled", "low", "true", _SHOWN, "indexing", "l1", "CAST(NULL AS VARCHAR)", "-1"),
    _rule("crawled_not_in_sitemap", "low", "true", _SHOWN, "indexing", "l2", "CAST(NULL AS VARCHAR)", "-1"),
))
def crawlability_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.crawlability(stored_pages(spark, sf_dir), sitemap(spark, sf_dir)).select(*FINDING)


def _url_key(x: str) -> str:
    host = f"regexp_replace(lower(regexp_extract({x}, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')"
    path = f"CASE WHEN regexp_extract({x}, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract({x}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/index\\.html$', '/') END"
    cut = f"CASE WHEN length({path}) > 1 AND ends_with({path}, '/') THEN left({path}, length({path}) - 1) ELSE {path} END"
    q = f"regexp_extract({x}, '[?]([^#]*)', 1)"
    return f"concat({host}, {cut}, CASE WHEN {q} <> '' THEN concat('?', array_to_string(list_sort(string_split({q}, '&')), '&')) ELSE '' END)"


_CANON = f""",
named0 AS (SELECT *, {_url_key('url')} AS alias FROM p UNION SELECT *, {_url_key('final_url')} FROM p),
target AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY page_id DESC) AS rn FROM named0) WHERE rn = 1),
named AS (SELECT *, {_url_key('canonical_url')} AS k FROM p WHERE canonical_url IS NOT NULL),
pair AS (SELECT n.page_id, n.url, t.url AS t_url, t.final_url AS t_final, t.fetch_error AS t_error, t.status_code AS t_status, t.hops AS t_hops, t.canonical_url AS t_canonical, t.noindex AS t_noindex
  FROM named n JOIN target t ON t.alias = n.k WHERE n.ok),
incoming AS (SELECT h.page_id, h.url, count(*) AS n, min(n.url) AS first FROM p h JOIN named n ON n.k = {_url_key('h.url')} AND n.url <> h.url WHERE h.noindex GROUP BY h.page_id, h.url)"""


@query(_PAGES + _CANON + _told(
    _rule("canonical_unreachable", "critical", "t_error IS NOT NULL OR t_status >= 400", "concat(t_url, ' ', coalesce(t_error, CAST(t_status AS VARCHAR)))", "indexing", "pair"),
    _rule("canonical_redirects", "high", "t_hops <> ''", "concat(t_url, ' ', t_final)", "indexing", "pair"),
    _rule("canonical_chain", "high", f"{_url_key('t_canonical')} <> {_url_key('t_url')}", "concat(t_url, ' ', t_canonical)", "indexing", "pair").replace("WHERE", "WHERE t_canonical IS NOT NULL AND"),
    _rule("canonical_to_noindex", "high", "t_noindex", "t_url", "indexing", "pair"),
    _rule("noindex_receives_canonicals", "high", "true", "concat(n, ' ', first)", "indexing", "incoming"),
    _rule("canonical_cross_domain", "low", "ok AND canonical_url IS NOT NULL AND regexp_replace(lower(regexp_extract(canonical_url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') <> regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')", "canonical_url", "indexing"),
))
def canonical_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.canonicals(crawl(spark, sf_dir)).select(*FINDING)


_ALL_KEYS = sorted({k for names in audit.REQUIRED.values() for k in names})
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_BLOCKS = f""",
block AS (
  SELECT page_id, url, ({_LIST(audit.REQUIRED)})[page_id % {len(audit.REQUIRED)} + 1] AS kind,
    list_filter({_LIST(_ALL_KEYS)}, lambda k, i: (page_id + i) % 3 <> 0) AS kept FROM v_crawl),
lack AS (
  SELECT page_id, url, kind, list_filter(CASE kind {" ".join(f"WHEN '{k}' THEN {_LIST(names)}" for k, names in audit.REQUIRED.items())} END, lambda k: NOT list_contains(kept, k)) AS missing FROM block)"""


def schema_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured-data blocks of the pages; the pages themselves have none, so each gets one whose type and keys follow its number."""
    kinds = F.array(*map(F.lit, audit.REQUIRED))
    keys = F.filter(F.array(*map(F.lit, _ALL_KEYS)), lambda k, i: (F.col("page_id") + i + 1) % 3 != 0)
    return views.view(spark, sf_dir, "v_crawl").select(*KEYS, F.col("page_id").alias("seq"), "url", F.get(kinds, F.pmod(F.col("page_id"), F.lit(len(audit.REQUIRED))).cast("int")).alias("type"), keys.alias("keys"))


@query(with_views("v_crawl") + _BLOCKS + _told(_rule("schema_required_fields", "medium", "len(missing) > 0", "concat(kind, ' ', array_to_string(missing, ','))", source="lack")))
def schema_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.schema_fields(schema_blocks(spark, sf_dir)).select(*FINDING)


@query(with_views("v_index_status") + _told(
    _rule("indexing_blocked", "critical", "indexing_state NOT IN ('INDEXING_ALLOWED', 'INDEXING_STATE_UNSPECIFIED')", "'robots meta tag'", "indexing", "v_index_status", page="-1"),
    _rule("fetch_failed", "critical", "page_fetch_state NOT IN ('SUCCESSFUL', 'PAGE_FETCH_STATE_UNSPECIFIED')", "page_fetch_state", "indexing", "v_index_status", page="-1"),
    _rule("canonical_rejected", "critical", "google_canonical <> user_canonical", "concat(user_canonical, ' ', google_canonical)", "indexing", "v_index_status", page="-1"),
))
def indexing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.indexing(views.view(spark, sf_dir, "v_index_status")).select(*FINDING)


def site_families(spark: SparkSession, sf_dir: str, whole: bool = False) -> list[DataFrame]:
    """Families of findings about the site in their order: pages, links, redirects, crawling, duplicates, hreflang, canonicals,
    structured data, keywords, index, competing pages. The pages are parsed once."""
    p, s = stored_pages(spark, sf_dir, whole), sitemap(spark, sf_dir)
    return [
        audit.on_page(p), audit.links(p, edges(spark, sf_dir), p.where("page_id = 0").select(*KEYS, "url")), audit.redirects(p, s), audit.crawlability(p, s),
        audit.duplicate_titles(p).unionByName(audit.duplicate_h1s(p)), audit.missing_hreflang(p), audit.canonicals(p), audit.schema_fields(schema_blocks(spark, sf_dir)),
        keywords.content_findings(matches(spark, sf_dir, p)), audit.indexing(views.view(spark, sf_dir, "v_index_status")),
        search.cannibalization_findings(views.view(spark, sf_dir, "v_search_performance")),
    ]


def site_findings(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """All of them as one written table, as collapsing, capping and marts read it more than once. Each family is written by itself
    first: one plan of all of them, planned anew after each of its stages, takes the driver's memory."""
    return stored(findings.all_findings(*(stored(family, "family") for family in site_families(spark, sf_dir, whole))), "findings")


@query(with_views("v_index_status") + ", f AS (" + _union(
    _rule("indexing blocked", "critical", "indexing_state NOT IN ('INDEXING_ALLOWED', 'INDEXING_STATE_UNSPECIFIED')", "''", "indexing", "v_index_status", page="-1"),
    _rule("fetch failed", "critical", "page_fetch_state NOT IN ('SUCCESSFUL', 'PAGE_FETCH_STATE_UNSPECIFIED')", "''", "indexing", "v_index_status", page="-1"),
    _rule("canonical rejected", "critical", "google_canonical <> user_canonical", "''", "indexing", "v_index_status", page="-1"),
) + "), g AS (SELECT rule, count(*) AS n, list_sort(list(url))[1:5] AS shown FROM f GROUP BY rule) SELECT rule AS title, concat(n, ' pages: ', array_to_string(shown, ', '), CASE WHEN n > 5 THEN concat(' (+', n - 5, ')') ELSE '' END) AS evidence FROM g WHERE n > 3")
def collapse_widespread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.indexing(views.view(spark, sf_dir, "v_index_status")).withColumn("seq", F.col("url"))
    return findings.collapse_widespread(rows).select("title", "evidence")


_MATCH = """,
shown AS (SELECT query, page, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS n FROM v_search_performance WHERE page <> '')
SELECT kw_id, coalesce(page, serp_url) AS url, CASE WHEN page IS NOT NULL THEN 'gsc' WHEN serp_url IS NOT NULL THEN 'serp' ELSE 'none' END AS match_source
FROM (SELECT kw_id, lower(keyword) AS k FROM (SELECT kw_id, min(keyword) AS keyword FROM v_serp GROUP BY kw_id)) kw
LEFT JOIN shown ON query = k AND n = 1
LEFT JOIN (SELECT kw_id, arg_min(url, position) AS serp_url FROM v_serp WHERE domain = 'client.com' GROUP BY kw_id) USING (kw_id)"""


def matches(spark: SparkSession, sf_dir: str, crawled: DataFrame | None = None) -> DataFrame:
    crawled = pages(spark, sf_dir) if crawled is None else crawled
    performance = views.view(spark, sf_dir, "v_search_performance").withColumn("seq", F.col("page"))
    return keywords.keyword_page_match(keyword_rows(spark, sf_dir), crawled, performance, serps(spark, sf_dir))


@query(with_views("v_serp", "v_search_performance") + _MATCH)
def keyword_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("kw_id", "url", "match_source")


@query(with_views("v_serp", "v_keywords") + """
SELECT 'content_gap' AS rule, count(*) AS n FROM v_keywords WHERE volume >= 500 AND kw_id IN (SELECT kw_id FROM v_serp)
  AND kw_id NOT IN (SELECT kw_id FROM v_serp WHERE domain = 'client.com')""")
def keyword_content_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.content_findings(matches(spark, sf_dir)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# a keyword of each page's own, by number: its title, its first heading, a piece of its text, and words that it lacks
_OWN_KEYWORD = "CASE page_id % 4 WHEN 0 THEN title WHEN 1 THEN h1s[{first}] WHEN 2 THEN substr(body_text, 11, 30) ELSE concat('lacking ', CAST(page_id AS STRING)) END"
_NAMED = _PAGES + f""",
k AS (SELECT page_id, keyword, {_norm('keyword')} AS nk FROM (SELECT page_id, {_OWN_KEYWORD.format(first=1)} AS keyword FROM p) WHERE {_norm('keyword')} <> ''),
best AS (SELECT nk, arg_max(url, page_id) AS url FROM k JOIN p USING (page_id) GROUP BY nk),
alias AS (SELECT alias, min(page_id) AS page_id FROM (SELECT url AS alias, page_id FROM p UNION ALL SELECT final_url, page_id FROM p) GROUP BY alias),
m AS (SELECT k.page_id AS kw_id, k.keyword, best.url, coalesce(contains({_norm('title')}, k.nk), false) AS in_title, coalesce(contains({_norm('body_text')}, k.nk), false) AS in_body,
    len(list_filter(h1s, lambda h: contains({_norm('h')}, k.nk))) > 0 AS in_h1, ok AS reliable
  FROM k JOIN best USING (nk) JOIN alias ON alias.alias = best.url JOIN p ON p.page_id = alias.page_id)"""


def _named(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    crawled = stored_pages(spark, sf_dir, whole)
    own = crawled.select(*KEYS, F.col("page_id").alias("kw_id"), "url", F.expr(_OWN_KEYWORD.format(first=0).replace("h1s[0]", "get(h1s, 0)")).alias("keyword")).where(tr_normalize(F.col("keyword")) != "")
    performance = own.select(*KEYS, F.col("keyword").alias("query"), F.col("url").alias("page"), F.col("kw_id").alias("impressions"), F.col("kw_id").alias("seq"))
    return keywords.keyword_page_match(own.select(*KEYS, "kw_id", "keyword", F.lit(1000).alias("volume")), crawled, performance, serps(spark, sf_dir))


@query(_NAMED + " SELECT kw_id, url, in_title, in_h1, in_body, reliable FROM m")
def page_keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's keyword, where its page names it."""
    return _named(spark, sf_dir).select("kw_id", "url", "in_title", "in_h1", "in_body", "reliable")


@query(whole_texts(_NAMED) + """ SELECT 'keyword_not_in_title' AS rule, 'high' AS severity, url, keyword AS evidence FROM m WHERE reliable AND NOT in_title
UNION ALL SELECT 'keyword_not_in_h1', 'medium', url, keyword FROM m WHERE reliable AND NOT in_h1 UNION ALL SELECT 'keyword_not_in_body', 'high', url, keyword FROM m WHERE reliable AND NOT in_body""")
def page_keyword_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.content_findings(_named(spark, sf_dir, whole=True)).select("rule", "severity", "url", "evidence")


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab audits with attribution structs; runs 0 and 1."""
    rows = views.view(spark, sf_dir, "v_tech_audits")
    lcp = F.struct(F.col("ttfb").alias("timeToFirstByte"), F.col("load_delay").alias("resourceLoadDelay"), F.col("load_duration").alias("resourceLoadDuration"), F.col("render_delay").alias("elementRenderDelay"))
    inp = F.struct(F.col("load_delay").alias("inputDelay"), F.col("inp_ms").alias("processingDuration"), F.col("render_delay").alias("presentationDelay"))
    return rows.withColumns({"lcp": lcp, "inp": F.when(F.col("inp_ms") % 2 == 0, inp), "shift": F.struct(F.col("largest_shift_time").alias("largestShiftTime"))})


def _rate(metric: str, x: str) -> str:
    good, fair = vitals.LIMITS[metric]
    return f"CASE WHEN {x} <= {good} THEN 'good' WHEN {x} <= {fair} THEN 'needs-improvement' ELSE 'poor' END"


_V = with_views("v_tech_audits") + ", a AS (SELECT *, ttfb + load_delay + load_duration + render_delay AS total, CASE WHEN inp_ms % 2 = 0 THEN load_delay + inp_ms + render_delay END AS inp_total FROM v_tech_audits)"


@query(_V + f" SELECT run_id, url, {_rate('LCP', 'lcp_ms')} AS lcp_rating, {_rate('CLS', 'cls')} AS cls_rating, CASE WHEN inp_ms % 2 = 0 THEN {_rate('INP', 'inp_ms')} END AS inp_rating, {_rate('TTFB', 'ttfb')} AS ttfb_rating FROM a")
def vitals_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vitals.ratings(audits(spark, sf_dir)).drop("client")


@query(_V + " SELECT run_id, url, round(CASE WHEN total > 0 THEN ttfb / CAST(total AS DOUBLE) ELSE 0 END, 6) AS s1, round(CASE WHEN total > 0 THEN load_delay / CAST(total AS DOUBLE) ELSE 0 END, 6) AS s2, round(CASE WHEN total > 0 THEN load_duration / CAST(total AS DOUBLE) ELSE 0 END, 6) AS s3, round(CASE WHEN total > 0 THEN render_delay / CAST(total AS DOUBLE) ELSE 0 END, 6) AS s4, CASE greatest(ttfb, load_delay, load_duration, render_delay) WHEN ttfb THEN 'timeToFirstByte' WHEN load_delay THEN 'resourceLoadDelay' WHEN load_duration THEN 'resourceLoadDuration' ELSE 'elementRenderDelay' END AS dominant, lcp_ms <= 2500 AND inp_ms <= 200 AND cls <= 0.1 AS passes FROM a")
def lcp_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = vitals.lcp_phases(F.col("lcp"))
    shares = [F.round(s, 6).alias(f"s{i + 1}") for i, s in enumerate(vitals.phase_shares(list(phases.values())))]
    return audits(spark, sf_dir).select("run_id", "url", *shares, vitals.dominant(phases).alias("dominant"), vitals.passes(F.col("lcp_ms"), F.col("inp_ms"), F.col("cls")).alias("passes"))


def _phase(name: str, metric: str, value: str, col: str, total: str, over: float) -> str:
    sev = f"CASE {_rate(metric, value)} WHEN 'poor' THEN 'critical' WHEN 'needs-improvement' THEN 'high' ELSE 'medium' END"
    return f"SELECT run_id, '{name}' AS rule, url, {sev} AS severity, round({col} / CAST({total} AS DOUBLE), 6) AS phase_share FROM a WHERE {total} > 0 AND {col} / CAST({total} AS DOUBLE) > {over}"


_SHIFT = "SELECT run_id, CASE WHEN largest_shift_time < 2500 THEN 'cls.loadShift' ELSE 'cls.lateShift' END AS rule, url, CASE WHEN cls > 0.25 THEN 'critical' ELSE 'high' END AS severity, CAST(NULL AS DOUBLE) AS phase_share FROM a WHERE cls > 0.1"


@query(_V + " " + _union(
    _phase("lcp.timeToFirstByte", "LCP", "lcp_ms", "ttfb", "total", 0.4), _phase("lcp.resourceLoadDelay", "LCP", "lcp_ms", "load_delay", "total", 0.1),
    _phase("lcp.resourceLoadDuration", "LCP", "lcp_ms", "load_duration", "total", 0.4), _phase("lcp.elementRenderDelay", "LCP", "lcp_ms", "render_delay", "total", 0.1),
    _phase("inp.inputDelay", "INP", "inp_ms", "load_delay", "inp_total", 0.5), _phase("inp.processingDuration", "INP", "inp_ms", "inp_ms", "inp_total", 0.5),
    _phase("inp.presentationDelay", "INP", "inp_ms", "render_delay", "inp_total", 0.5), _SHIFT,
))
def vitals_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vitals.diagnose(audits(spark, sf_dir)).select("run_id", "rule", "url", "severity", F.round("phase_share", 6).alias("phase_share"))


@query("WITH RECURSIVE " + with_views("v_page_links").removeprefix("WITH ") + """,
reach(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT target_id, depth + 1 FROM reach JOIN v_page_links ON source_id = node WHERE depth < 5)
SELECT node, min(depth) AS depth FROM reach GROUP BY node""")
def click_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(spark, sf_dir, "v_page_links").select(*KEYS, F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    seeds = spark.range(1, 2).select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.col("id").alias("node"))
    return graph.click_depth(rows, seeds).select("node", "depth")


_SECTION = "CASE target_id % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'shop' ELSE 'p' END"
_HOST = "CASE WHEN target_id % 11 = 0 THEN 'elsewhere.example' ELSE concat(client, '.example') END"


def _crawl_sql(depths: int = 5, budget: int = 300) -> str:
    """A wave after the other: new allowed addresses by the place of the page and the position of the link that lead there first."""
    allowed = "target_id % 11 <> 0 AND NOT (client = 'a' AND target_id % 7 = 0) AND (target_id % 7 <> 1 OR CAST(target_id AS VARCHAR) LIKE '1%' OR (client = 'b' AND CAST(target_id AS VARCHAR) LIKE '%5'))"
    sql = with_views("v_page_links") + f""", s AS (SELECT unnest(['a', 'b']) AS client),
  l AS (SELECT client, source_id, target_id FROM v_page_links, s WHERE {allowed}),
  w0 AS (SELECT client, CASE client WHEN 'a' THEN 2 ELSE 3 END AS id, 0 AS depth, 1 AS place FROM s)"""
    for d in range(1, depths + 1):
        before = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(d))
        sql += f""", b{d} AS ({before}),
  c{d} AS (SELECT l.client, target_id AS id, min(place * 10000000000 + target_id) AS first_met FROM l JOIN w{d - 1} w ON w.client = l.client AND w.id = source_id
    WHERE NOT EXISTS (SELECT 1 FROM b{d} b WHERE b.client = l.client AND b.id = target_id) GROUP BY l.client, target_id),
  w{d} AS (SELECT * FROM (SELECT client, id, {d} AS depth, row_number() OVER (PARTITION BY client ORDER BY first_met) + (SELECT count(*) FROM b{d} b WHERE b.client = c{d}.client) AS place FROM c{d}) WHERE place <= {budget})"""
    return sql + " SELECT client, id AS node, depth, CAST(place AS INT) AS place FROM (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(depths + 1)) + ")"


@query(_crawl_sql())
def crawl_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls of two sites over one graph, with other exclusions and robots rules, within the default depth and page budget."""
    both = views.view(spark, sf_dir, "v_page_links").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("client"), F.lit(1).alias("run_id"), "source_id", "target_id")
    address = lambda node: F.expr(f"concat('https://', {_HOST}, '/', {_SECTION}, '/', target_id)".replace("target_id", node))
    edges = both.select(*KEYS, address("source_id").alias("source"), address("target_id").alias("target"), F.col("target_id").alias("position"))
    seeds = spark.createDataFrame([("a", 1, "https://a.example/p/2", 0), ("b", 1, "https://b.example/p/3", 0)], "client string, run_id int, url string, position int")
    sites = spark.createDataFrame([("a", "a.example", ["/private"]), ("b", "b.example", [])], "client string, domain string, excluded array<string>")
    text = F.concat(F.lit("User-agent: *\nDisallow: /shop/\nAllow: /shop/1\n"), F.when(F.col("client") == "b", "Allow: /shop/*5$\n").otherwise(""))
    rules = ingest.robots_rules(sites.select(F.col("domain").alias("host"), text.alias("content")))
    found = graph.crawl_waves(edges, seeds, sites, rules)
    return found.select("client", F.substring_index("url", "/", -1).cast("long").alias("node"), "depth", "place")


@query(_PAGES + """, g AS (SELECT 'duplicate_title' AS rule, title AS k, url FROM p WHERE ok AND title <> '' UNION ALL SELECT 'duplicate_h1', h1s[1], url FROM p WHERE ok AND h1s[1] <> '')
SELECT rule, k, url, count(*) OVER (PARTITION BY rule, k) AS n FROM g QUALIFY n > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages share a title or a first heading: the membership of every group."""
    rows = pages(spark, sf_dir)
    of = lambda rule, key: audit.duplicate_members(rows, key).select(F.lit(rule).alias("rule"), "k", "url", "n")
    return of("duplicate_title", F.col("title")).unionByName(of("duplicate_h1", F.get("h1s", F.lit(0))))
