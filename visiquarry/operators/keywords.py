"""Keywords: intent, clusters, ranks, opportunities, the pages that answer them, and what those pages lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import classify_intent, cluster_id, tr_contains, tr_normalize
from ..functions.urls import url_template
from .findings import finding
from .keys import KEYS, first_by, round_half_up, top
from .ranking import place_all

MAX_AUDIT_URLS = 4
MIN_VOLUME = 500


def first_serps(serps: DataFrame) -> DataFrame:
    """Rows of the first result page of every keyword in normal form; serps: keyword, serp_id, position, domain, url, flags."""
    rows = serps.withColumn("kw", tr_normalize(F.col("keyword")))
    first = rows.groupBy(*KEYS, "kw").agg(F.min("serp_id").alias("serp_id"))
    return rows.join(first, [*KEYS, "kw", "serp_id"])


def serp_summary(serps: DataFrame) -> DataFrame:
    """client, run_id, kw, client_rank, ai, snippet of every keyword's first result page: two aggregates over one reading."""
    pages = serps.withColumn("kw", tr_normalize(F.col("keyword"))).groupBy(*KEYS, "kw", "serp_id").agg(
        F.min(F.when(F.col("domain") == F.col("client"), F.col("position"))).alias("client_rank"), F.bool_or("has_ai_overview").alias("ai"), F.bool_or("has_featured_snippet").alias("snippet"),
    )
    return pages.groupBy(*KEYS, "kw").agg(F.min_by(F.struct("client_rank", "ai", "snippet"), "serp_id").alias("s")).select(*KEYS, "kw", "s.*")


def client_rank(keywords: DataFrame, serps: DataFrame) -> DataFrame:
    """keywords with client_rank, the client's place on the keyword's first result page, null if it has none."""
    own = serp_summary(serps).select(*KEYS, "kw", "client_rank")
    return keywords.withColumn("kw", tr_normalize(F.col("keyword"))).join(own, [*KEYS, "kw"], "left").drop("kw")


def enrich(keywords: DataFrame, serps: DataFrame, brand_tokens: list[str]) -> DataFrame:
    """keywords with intent, cluster_id and client_rank."""
    brands = F.array(*map(F.lit, brand_tokens)).cast("array<string>")
    ranked = client_rank(keywords, serps).withColumn("intent", classify_intent(F.col("keyword"), brands))
    return ranked.withColumn("cluster_id", cluster_id(F.col("keyword"), F.col("intent")))


def clusters(rows: DataFrame, seq: str = "kw_id") -> DataFrame:
    """One row per cluster; its representative is the keyword with most volume, the first of equal ones."""
    best = F.max_by(F.struct("keyword", "intent"), F.struct(F.col("volume"), -F.col(seq)))
    return rows.groupBy(*KEYS, "cluster_id").agg(
        best.alias("b"), F.count(F.lit(1)).alias("n_keywords"), F.sum("volume").alias("total_volume"),
        F.avg("difficulty").alias("avg_difficulty"), F.min("client_rank").alias("best_client_rank"),
    ).select(*KEYS, "cluster_id", F.col("b.keyword").alias("representative"), F.col("b.intent").alias("intent"), "n_keywords", "total_volume", "avg_difficulty", "best_client_rank")


def cluster_members(rows: DataFrame, seq: str = "kw_id") -> DataFrame:
    """The keywords of every cluster, a row each with its place by volume; the first is the cluster's representative. No cluster is
    gathered in one row or task."""
    return place_all(rows.select(*KEYS, "cluster_id", "keyword", "volume", seq), [*KEYS, "cluster_id"], [F.desc("volume"), F.asc(seq)])


def serp_features(keywords: DataFrame, serps: DataFrame) -> DataFrame:
    flags = serp_summary(serps).select(*KEYS, "kw", "ai", "snippet")
    out = keywords.withColumn("kw", tr_normalize(F.col("keyword"))).join(flags, [*KEYS, "kw"], "left").drop("kw")
    return out.withColumns({"ai": F.coalesce("ai", F.lit(False)), "snippet": F.coalesce("snippet", F.lit(False))})


def volume_norm(volume: Column) -> Column:
    return F.least(F.log10(F.greatest(volume, F.lit(1)).cast("double")) / 5, F.lit(1.0))


def rank_gap_factor(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.8).when(rank.between(4, 20), 1.0).when(rank < 4, 0.2).otherwise(0.6)


def serp_feature_factor(ai: Column, snippet: Column, intent: Column) -> Column:
    return F.when(ai, 0.85).otherwise(1.0) * F.when(~snippet & (intent == "informational"), 1.15).otherwise(1.0)


def opportunities(rows: DataFrame, serps: DataFrame) -> DataFrame:
    """rows with score 0 to 100 and the codes of its reasons."""
    out = serp_features(rows, serps)
    score = volume_norm(F.col("volume")) * (1 - F.col("difficulty")) * rank_gap_factor(F.col("client_rank")) * serp_feature_factor(F.col("ai"), F.col("snippet"), F.col("intent")) * 100
    rank = F.col("client_rank")
    place = F.when(rank.isNull(), "not_ranked").when(rank < 4, "hold").when(rank <= 20, "striking_distance").otherwise("weak")
    reasons = F.array_compact(F.array(place, F.when(F.col("ai"), "ai_overview"), F.when(F.col("snippet"), "featured_snippet_taken")))
    return out.withColumns({"score": round_half_up(score).cast("long"), "reasons": reasons})


def rank_opportunities(scored: DataFrame, n: int | None = None, seq: str = "kw_id") -> DataFrame:
    """The best ``n`` of each run, by score, then volume; without ``n`` all of them with their places."""
    order = [F.desc("score"), F.desc("volume"), F.asc(seq)]
    return place_all(scored, [*KEYS], order) if n is None else top(scored, n, [*KEYS], order)


def select_audit_urls(serps: DataFrame, clients: DataFrame, n: int = MAX_AUDIT_URLS) -> DataFrame:
    """client, run_id, place, url: configured URLs in their order, then the client's best page of each URL template."""
    own = serps.where("domain = client").withColumn("template", url_template(F.col("url")))
    best = first_by(own, [*KEYS, "template"], [F.asc("position"), F.asc("serp_id"), F.asc("url")])
    found = best.select(*KEYS, "url", F.lit(1).alias("from"), F.col("position").cast("long").alias("at"), F.col("serp_id").cast("long").alias("seq"))
    runs = serps.select(*KEYS).distinct()
    given = runs.join(clients.select("client", F.posexplode("audit_urls").alias("at", "url")), "client").select(*KEYS, "url", F.lit(0).alias("from"), F.col("at").cast("long"), F.lit(0).cast("long").alias("seq"))
    once = first_by(given.unionByName(found), [*KEYS, "url"], [F.asc("from"), F.asc("at"), F.asc("seq")])
    return top(once, n, [*KEYS], [F.asc("from"), F.asc("at"), F.asc("seq"), F.asc("url")]).select(*KEYS, "place", "url")


def crawl_seeds(runs: DataFrame, audit_urls: DataFrame) -> DataFrame:
    """client, run_id, place, url: every run's home page, then the URLs chosen for its audits, each once. audit_urls: client, run_id, place, url."""
    home = runs.select(*KEYS).distinct().withColumns({"place": F.lit(0), "url": F.concat(F.lit("https://"), "client", F.lit("/"))})
    return home.unionByName(audit_urls.select(*KEYS, "place", "url")).groupBy(*KEYS, "url").agg(F.min("place").alias("place"))


def regroup(rows: DataFrame) -> DataFrame:
    """One row per keyword of a run from its result rows: entries in order of position, each flag true if any row has it. A result
    page has some ten or a hundred positions, so its rows fit one array."""
    entries = F.sort_array(F.collect_list(F.struct("position", "domain", "url")))
    return rows.groupBy(*KEYS, "keyword").agg(entries.alias("entries"), *(F.bool_or(c).alias(c) for c in ("has_featured_snippet", "has_ai_overview")))


def page_aliases(pages: DataFrame, last: bool = False) -> DataFrame:
    """alias, page columns: a page answers to its URL and to the URL it ended at; the first page wins, or the last."""
    named = pages.select("*", F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url")))).alias("alias"))
    return first_by(named, [*KEYS, "alias"], [F.desc("seq") if last else F.asc("seq")])


def keyword_page_match(keywords: DataFrame, pages: DataFrame, performance: DataFrame, serps: DataFrame) -> DataFrame:
    """For every keyword its page: the one with most impressions, else the client's on the result page; and where it names the keyword."""
    shown = performance.where("page <> ''").withColumn("kw", tr_normalize(F.col("query")))
    gsc = first_by(shown, [*KEYS, "kw"], [F.desc("impressions"), F.asc("seq")]).select(*KEYS, "kw", F.col("page").alias("gsc_url"))
    own = first_by(first_serps(serps).where("domain = client"), [*KEYS, "kw"], [F.asc("position")]).select(*KEYS, "kw", F.col("url").alias("serp_url"))
    out = keywords.withColumn("kw", tr_normalize(F.col("keyword"))).join(gsc, [*KEYS, "kw"], "left").join(own, [*KEYS, "kw"], "left")
    out = out.withColumns({
        "match_source": F.when(F.col("gsc_url").isNotNull(), "gsc").when(F.col("serp_url").isNotNull(), "serp").otherwise("none"),
        "alias": F.coalesce("gsc_url", "serp_url"),
    }).drop("gsc_url", "serp_url", "kw")
    crawled = page_aliases(pages).select(*KEYS, "alias", F.lit(True).alias("crawled"), "title", "h1s", "body_text", "status_code", "is_client_rendered")
    out = out.join(crawled, [*KEYS, "alias"], "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        *KEYS, "kw_id", "keyword", "volume", F.col("alias").alias("url"), "match_source",
        has(tr_contains(F.col("title"), F.col("keyword"))).alias("in_title"),
        has(F.exists("h1s", lambda h: tr_contains(h, F.col("keyword")))).alias("in_h1"),
        has(tr_contains(F.col("body_text"), F.col("keyword"))).alias("in_body"),
        has(F.col("status_code").between(200, 299) & ~has(F.col("is_client_rendered"))).alias("reliable"),
    )


def content_findings(matches: DataFrame, min_volume: int = MIN_VOLUME) -> DataFrame:
    """Keywords that their page does not name in title, first heading or text, and keywords of some volume without a page."""
    detail = F.concat_ws(" ", F.col("keyword"))
    rules = F.array_compact(F.array(
        F.when(F.col("reliable") & ~F.col("in_title"), finding("keyword_not_in_title", "content", "high", F.col("url"), detail, detail=detail)),
        F.when(F.col("reliable") & ~F.col("in_h1"), finding("keyword_not_in_h1", "content", "medium", F.col("url"), detail, detail=detail)),
        F.when(F.col("reliable") & ~F.col("in_body"), finding("keyword_not_in_body", "content", "high", F.col("url"), detail, detail=detail)),
        F.when(F.col("url").isNull() & (F.col("volume") >= min_volume), finding("content_gap", "content", "medium", F.lit(None).cast("string"), detail, detail=detail)),
    ))
    return matches.select(*KEYS, F.explode(rules).alias("f")).select(*KEYS, "f.*")
