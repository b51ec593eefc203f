"""Queries over keywords, competitors, search performance and AI answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import ai, competitors, keywords, search
from . import views
from .registry import query
from .views import with_views


def serps(spark: SparkSession, sf_dir: str, name: str = "v_serp") -> DataFrame:
    return views.view(spark, sf_dir, name).withColumnRenamed("kw_id", "serp_id")


def clients(spark: SparkSession) -> DataFrame:
    seeds = F.array(*map(F.lit, views.SEEDS))
    urls = F.array(F.lit("https://client.com/"), F.lit("https://client.com/contact"))
    return spark.range(1).select(F.lit(views.CLIENT).alias("client"), seeds.alias("seeds"), urls.alias("audit_urls"))


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with their figures, intent, cluster and rank."""
    named = views.view(spark, sf_dir, "v_serp").groupBy("kw_id").agg(F.min("keyword").alias("keyword"))
    return keywords.enrich(views.view(spark, sf_dir, "v_keywords").join(named, "kw_id"), serps(spark, sf_dir), list(views.BRANDS))


_NORM = "trim(lower(translate({0}, 'Iİ', 'ıi')))"


def _norm(x: str) -> str:
    return _NORM.format(x)


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(nk, '{w}')" for w in words) + ")"


_KINDS = " ".join(f"WHEN regexp_matches(domain, '(^|\\.)({'|'.join(n.replace('.', chr(92) + '.') for n in names)})$') THEN '{kind}'" for kind, names in competitors.EXCLUDED.items())
_KIND = f"CASE {_KINDS} ELSE 'business' END"

_COMPETITORS = f"""
shown AS (SELECT DISTINCT kw_id, domain FROM v_serp),
total AS (SELECT count(DISTINCT kw_id) AS pages FROM v_serp),
counted AS (SELECT domain, count(*) / CAST(greatest(any_value(pages), 1) AS DOUBLE) AS rate FROM shown, total WHERE domain <> 'client.com' GROUP BY domain),
every AS (SELECT * FROM counted UNION ALL SELECT 'absent-rival.com', 0.0 WHERE NOT EXISTS (SELECT 1 FROM counted WHERE domain = 'absent-rival.com')),
competitor AS (
  SELECT domain, rate, round(rate, 6) AS appearance_rate, {_KIND} AS classification,
    domain = 'absent-rival.com' OR (rate >= 0.15 AND {_KIND} = 'business') AS is_real_competitor,
    CASE WHEN domain = 'absent-rival.com' THEN 'seed' ELSE 'discovered' END AS source
  FROM every)"""


def _competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competitors.discover(serps(spark, sf_dir), clients(spark))


@query(with_views("v_serp") + "," + _COMPETITORS + " SELECT * EXCLUDE (rate) FROM competitor")
def discover_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _competitors(spark, sf_dir)
    return found.select("domain", F.round("appearance_rate", 6).alias("appearance_rate"), "classification", "is_real_competitor", "source")


@query(with_views("v_serp") + "," + _COMPETITORS + " SELECT domain FROM competitor WHERE is_real_competitor")
def real_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competitors.real(_competitors(spark, sf_dir)).select("domain")


@query(with_views("v_serp") + "," + _COMPETITORS + """
SELECT domain, appearance_rate, place FROM (
  SELECT *, row_number() OVER (ORDER BY rate DESC, domain) AS place FROM (
    SELECT *, row_number() OVER (ORDER BY rate DESC, domain) AS seen FROM competitor)
  WHERE is_real_competitor OR seen <= 20) WHERE place <= 20""")
def competitor_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.marts import competitor_map as mart

    return mart(_competitors(spark, sf_dir)).select("domain", F.round("appearance_rate", 6).alias("appearance_rate"), "place")


_MARKERS = ", ".join(f"'{w}'" for w in T.marker_words())
_KEYWORDS = f"""
named AS (SELECT kw_id, min(keyword) AS keyword FROM v_serp GROUP BY kw_id),
nk AS (SELECT k.*, keyword, {_norm('keyword')} AS nk FROM v_keywords k JOIN named USING (kw_id)),
firsts AS (SELECT {_norm('keyword')} AS nk, min(kw_id) AS kw_id FROM v_serp GROUP BY 1),
first_serp AS (SELECT s.*, f.nk FROM v_serp s JOIN firsts f ON s.kw_id = f.kw_id AND {_norm('s.keyword')} = f.nk),
ranks AS (SELECT nk, min(position) AS client_rank FROM first_serp WHERE domain = 'client.com' GROUP BY nk),
intents AS (
  SELECT nk.*, client_rank,
    CASE WHEN contains(nk.nk, 'brand#2') THEN 'branded' WHEN {_any(T.LOCAL + T.CITIES)} THEN 'local'
         WHEN {_any(T.COMMERCIAL)} THEN 'commercial' WHEN {_any(T.INFORMATIONAL)} THEN 'informational' ELSE 'commercial' END AS intent
  FROM (SELECT nk.*, client_rank FROM nk LEFT JOIN ranks USING (nk)) nk),
words AS (
  SELECT kw_id, unnest(string_split_regex(nk, '\\s+')) AS word, generate_subscripts(string_split_regex(nk, '\\s+'), 1) AS spot FROM intents),
stems AS (
  SELECT kw_id, arg_min(word, spot) AS word FROM (
    SELECT *, max(length(word)) OVER (PARTITION BY kw_id) AS longest FROM words
    WHERE length(word) >= 3 AND NOT list_bool_or(list_transform([{_MARKERS}], lambda m: starts_with(word, m))))
  WHERE length(word) = longest GROUP BY kw_id),
kw AS (
  SELECT intents.*, concat(substr(coalesce(word, 'genel'), 1, 5), '-', intent) AS cluster_id FROM intents LEFT JOIN stems USING (kw_id))"""
_KEYWORDS = _KEYWORDS.replace("contains(nk, ", "contains(nk.nk, ")
_KW = with_views("v_serp", "v_keywords") + "," + _KEYWORDS


@query(_KW + " SELECT kw_id, keyword, intent, cluster_id, client_rank FROM kw")
def enrich_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_rows(spark, sf_dir).select("kw_id", "keyword", "intent", "cluster_id", "client_rank")


@query(_KW + """
SELECT cluster_id, arg_max(keyword, volume * 100000000 - kw_id) AS representative, arg_max(intent, volume * 100000000 - kw_id) AS intent,
  count(*) AS n_keywords, CAST(sum(volume) AS BIGINT) AS total_volume, round(avg(difficulty), 6) AS avg_difficulty, min(client_rank) AS best_client_rank
FROM kw GROUP BY cluster_id""")
def keyword_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keywords.clusters(keyword_rows(spark, sf_dir))
    return out.select("cluster_id", "representative", "intent", "n_keywords", "total_volume", F.round("avg_difficulty", 6).alias("avg_difficulty"), "best_client_rank")


@query(_KW + " SELECT cluster_id, kw_id, keyword, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY volume DESC, kw_id) AS INTEGER) AS place FROM kw")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.cluster_members(keyword_rows(spark, sf_dir)).select("cluster_id", "kw_id", "keyword", "place")


_SCORED = """,
flags AS (SELECT nk, bool_or(has_ai_overview) AS ai, bool_or(has_featured_snippet) AS snippet FROM first_serp GROUP BY nk),
scored AS (
  SELECT kw.*, coalesce(ai, false) AS ai, coalesce(snippet, false) AS snippet,
    CAST(floor(least(log10(CAST(greatest(volume, 1) AS DOUBLE)) / 5, CAST(1 AS DOUBLE)) * (1 - difficulty)
      * CASE WHEN client_rank IS NULL THEN CAST(0.8 AS DOUBLE) WHEN client_rank BETWEEN 4 AND 20 THEN CAST(1 AS DOUBLE) WHEN client_rank < 4 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END
      * (CASE WHEN coalesce(ai, false) THEN CAST(0.85 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CASE WHEN NOT coalesce(snippet, false) AND intent = 'informational' THEN CAST(1.15 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)
      * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS score
  FROM kw LEFT JOIN flags USING (nk))"""


@query(_KW + _SCORED + " SELECT kw_id, score, row_number() OVER (ORDER BY score DESC, volume DESC, kw_id) AS place FROM scored")
def rank_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = keywords.opportunities(keyword_rows(spark, sf_dir), serps(spark, sf_dir))
    return keywords.rank_opportunities(scored).select("kw_id", "score", "place")


@query(_KW + _SCORED + """ SELECT kw_id, concat_ws(',',
  CASE WHEN client_rank IS NULL THEN 'not_ranked' WHEN client_rank < 4 THEN 'hold' WHEN client_rank <= 20 THEN 'striking_distance' ELSE 'weak' END,
  CASE WHEN ai THEN 'ai_overview' END, CASE WHEN snippet THEN 'featured_snippet_taken' END) AS reasons FROM scored""")
def opportunity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = keywords.opportunities(keyword_rows(spark, sf_dir), serps(spark, sf_dir))
    return scored.select("kw_id", F.array_join("reasons", ",").alias("reasons"))


@query(with_views("v_serp") + """,
own AS (
  SELECT url, position, kw_id, CASE len(parts) WHEN 0 THEN '/' WHEN 1 THEN '/:sayfa' ELSE concat('/', parts[1], '/', array_to_string(list_transform(parts[2:], lambda p: ':sayfa'), '/')) END AS template
  FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '/'), lambda s: s <> '') AS parts FROM v_serp WHERE domain = 'client.com')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY position, kw_id, url) AS n FROM own) WHERE n = 1)
SELECT row_number() OVER (ORDER BY src, nth, seq, url) AS place, url FROM (
  SELECT 'https://client.com/' AS url, 0 AS src, 0 AS nth, 0 AS seq UNION ALL SELECT 'https://client.com/contact', 0, 1, 0
  UNION ALL SELECT url, 1, position, kw_id FROM best) QUALIFY row_number() OVER (ORDER BY src, nth, seq, url) <= 4""")
def select_audit_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.select_audit_urls(serps(spark, sf_dir), clients(spark)).select("place", "url")


_CANNIBAL = """,
placed AS (
  SELECT *, row_number() OVER w AS place, first_value(page) OVER w AS "primary", first_value(impressions) OVER w AS most
  FROM v_search_performance WHERE page <> '' WINDOW w AS (PARTITION BY query ORDER BY impressions DESC, page)),
second AS (SELECT *, impressions / CAST(most AS DOUBLE) AS share FROM placed WHERE place > 1 AND impressions / CAST(most AS DOUBLE) >= 0.2)
SELECT query, "primary", most AS primary_impressions, count(*) AS n_secondary, round(max(share), 6) AS top_share,
  string_agg(page, ',' ORDER BY page) AS secondary_pages, CAST(least(100, 45 + floor(max(share) * 30 + 0.5)) AS INTEGER) AS impact
FROM second GROUP BY 1, 2, 3"""


@query(with_views("v_search_performance") + _CANNIBAL)
def cannibalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.cannibalization(views.view(spark, sf_dir, "v_search_performance"))
    return out.select("query", "primary", "primary_impressions", "n_secondary", F.round("top_share", 6).alias("top_share"), "secondary_pages", "impact")


@query(with_views("v_search_performance") + """
SELECT query, page, impressions, place FROM (SELECT *, row_number() OVER (ORDER BY impressions DESC, query, page) AS place FROM v_search_performance) WHERE place <= 30""")
def search_performance_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_rows(views.view(spark, sf_dir, "v_search_performance")).select("query", "page", "impressions", "place")


def _key(x: str) -> str:
    return f"regexp_replace(translate({_norm(x)}, 'ığüşöç', 'igusoc'), '[^a-z0-9]+', '', 'g')"


_AI = with_views("v_ai_answers") + f""",
keyed AS (SELECT *, {_key('text')} AS k FROM v_ai_answers),
said AS (
  SELECT *, contains(k, 'ation') AS client_mentioned, list_filter(['erin.com', 'ment.com', 'thand.com'], lambda d: contains(k, split_part(d, '.', 1))) AS named
  FROM keyed)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.detect_mentions(views.view(spark, sf_dir, "v_ai_answers"), _brands(spark), _rivals(spark))


def _brands(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(views.CLIENT).alias("client"), F.explode(F.array(*map(F.lit, views.AI_BRANDS))).alias("token"))


def _rivals(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(views.CLIENT).alias("client"), F.lit(1).alias("run_id"), F.explode(F.array(*map(F.lit, views.AI_COMPETITORS))).alias("domain"))


@query(_AI + " SELECT conv_id, sample_index, client_mentioned, array_to_string(named, ',') AS competitors_mentioned, substr(text, 1, 300) AS answer_excerpt FROM said")
def detect_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("conv_id", "sample_index", "client_mentioned", F.array_join("competitors_mentioned", ",").alias("competitors_mentioned"), "answer_excerpt")


_LISTS = with_views("v_client_answers", "v_client_brands", "v_client_rivals") + f""",
b AS (SELECT client, {_key('token')} AS k FROM v_client_brands), c AS (SELECT client, domain, split_part(domain, '.', 1) AS label, {_key("split_part(domain, '.', 1)")} AS k FROM v_client_rivals)"""


@query(_LISTS + f""", a AS (SELECT *, {_key('text')} AS k FROM v_client_answers)
SELECT conv_id, sample_index, client, EXISTS (SELECT 1 FROM b WHERE b.client = a.client AND b.k <> '' AND contains(a.k, b.k)) AS client_mentioned,
  coalesce((SELECT string_agg(DISTINCT domain, ',' ORDER BY domain) FROM c WHERE c.client = a.client AND length(label) >= 3 AND contains(a.k, c.k)), '') AS competitors_mentioned FROM a""")
def client_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about 25 clients, each against its own brands and rivals."""
    out = ai.detect_mentions(*(views.view(spark, sf_dir, v) for v in ("v_client_answers", "v_client_brands", "v_client_rivals")))
    return out.select("conv_id", "sample_index", "client", "client_mentioned", F.array_join("competitors_mentioned", ",").alias("competitors_mentioned"))


_RATES = """,
rates AS (SELECT query, count(*) AS sample_count, avg(CAST(client_mentioned AS INTEGER)) AS client_rate FROM said GROUP BY query),
rival AS (SELECT query, d AS domain, sample_count, client_rate, (SELECT count(*) FROM said s WHERE s.query = rates.query AND list_contains(named, d)) / CAST(sample_count AS DOUBLE) AS rate
  FROM rates, (SELECT unnest(['ment.com', 'erin.com', 'thand.com']) AS d))"""


@query(_AI + _RATES + """ SELECT query, sample_count, round(client_rate, 6) AS client_rate, round(max(rate), 6) AS top_rate,
  CASE WHEN max(rate) > 0 THEN arg_min(domain, concat(CAST(1 - rate AS DECIMAL(9, 6)), domain)) END AS top_competitor, client_rate < 0.34 AND max(rate) >= 0.5 AS is_gap
FROM rival GROUP BY query, sample_count, client_rate""")
def ai_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ai.visibility(_samples(spark, sf_dir), _rivals(spark))
    return out.select("query", "sample_count", F.round("client_rate", 6).alias("client_rate"), F.round("top_rate", 6).alias("top_rate"), "top_competitor", "is_gap")


@query(_AI + _RATES + " SELECT query, domain, round(rate, 6) AS rate FROM rival")
def ai_competitor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.competitor_rates(_samples(spark, sf_dir), _rivals(spark)).select("query", "domain", F.round("rate", 6).alias("rate"))


@query(with_views("v_serp") + f""" SELECT kw_id, position, {_norm('keyword')} AS normal,
  trim(regexp_replace(translate({_norm('keyword')}, 'ığüşöç', 'igusoc'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '^www\\.', '') AS root FROM v_serp""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(spark, sf_dir, "v_serp")
    return rows.select("kw_id", "position", T.tr_normalize(F.col("keyword")).alias("normal"), T.slugify(F.col("keyword")).alias("slug"), T.root_domain(F.col("url")).alias("root"))


@query("""
SELECT page_id, CASE len(parts) WHEN 0 THEN '/' WHEN 1 THEN '/:sayfa' ELSE concat('/', parts[1], '/', array_to_string(list_transform(parts[2:], lambda p: ':sayfa'), '/')) END AS template,
  concat(host, CASE WHEN length(path) > 1 AND ends_with(path, '/') THEN left(path, length(path) - 1) ELSE path END, CASE WHEN q <> '' THEN concat('?', array_to_string(list_sort(string_split(q, '&')), '&')) ELSE '' END) AS url_key,
  lower(regexp_extract(path, '^/+([A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:/|$)', 1)) AS locale
FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host,
    CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path,
    regexp_extract(url, '[?]([^#]*)', 1) AS q,
    list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages)""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", U.url_template(F.col("url")).alias("template"), U.canonical_url_key(F.col("url")).alias("url_key"), U.locale_prefix(F.col("url")).alias("locale"))
