"""Site audit: findings about pages, links, canonicals, crawling, indexing and structured data.

``pages``: client, run_id, seq, url, final_url, status_code, fetch_error, title, meta_description, canonical_url, h1s,
schema_types, og_complete, images_missing_alt, images_missing_dimensions, word_count, depth, viewport, lang, meta_robots,
x_robots_tag, content_type, mixed_content, hreflangs, header_hreflangs, redirect_statuses, redirect_loop, is_client_rendered.
All rules about a page alone are one array column over one scan; rules about other rows name their join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url_key, locale_prefix, url_host
from .findings import finding
from .keys import KEYS, first_by

TITLE_MAX, DESCRIPTION_MAX, MIN_WORDS, DEEP = 60, 160, 150, 3
PREVIEW = 5

# Keys that search engines require of structured data, by type.
REQUIRED = {
    "Product": ("name", "offers", "offers.price", "offers.priceCurrency", "offers.availability"),
    "Article": ("headline", "author", "datePublished"),
    "BlogPosting": ("headline", "author", "datePublished"),
    "LocalBusiness": ("name", "address", "telephone"),
    "BreadcrumbList": ("itemListElement",),
    "Organization": ("name", "url"),
    "FAQPage": ("mainEntity",),
}


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def evaluable() -> Column:
    return _or_false(F.col("status_code").between(200, 299))


def noindexed(robots: str = "meta_robots", header: str = "x_robots_tag") -> Column:
    return F.contains(F.lower(F.concat_ws(" ", robots, header)), F.lit("noindex"))


def failed(error: Column, status: Column) -> Column:
    return error.isNotNull() | _or_false(status >= 400)


def _emit(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """One row for every (rule, category, severity, condition, evidence[, detail of the title]) that holds of a row with ``url``;
    ``seq`` is the page's, null for rows without one."""
    each = (F.when(_or_false(cond), finding(rule, category, severity, F.col("url"), evidence, detail=detail[0] if detail else None)) for rule, category, severity, cond, evidence, *detail in rules)
    seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(None).cast("long")
    return df.select(*KEYS, seq.alias("seq"), F.explode(F.array_compact(F.array(*each))).alias("f")).select(*KEYS, "seq", "f.*")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def on_page(pages: DataFrame) -> DataFrame:
    """Sixteen rules about a page that was read; a page that scripts build is spared those that its HTML cannot answer."""
    n = lambda c: F.col(c).cast("string")
    server = ~_or_false(F.col("is_client_rendered"))
    none = F.lit("")
    rules = [
        ("client_rendered", "onpage", "medium", ~server, none),
        ("missing_title", "onpage", "critical", server & _blank("title"), none),
        ("title_too_long", "onpage", "low", F.length("title") > TITLE_MAX, F.length("title").cast("string")),
        ("meta_description_missing", "onpage", "medium", _blank("meta_description"), none),
        ("meta_description_too_long", "onpage", "low", F.length("meta_description") > DESCRIPTION_MAX, F.length("meta_description").cast("string")),
        ("missing_h1", "onpage", "high", server & (F.size("h1s") == 0), none),
        ("multiple_h1", "onpage", "medium", F.size("h1s") > 1, F.size("h1s").cast("string"), F.size("h1s")),
        ("missing_canonical", "onpage", "medium", F.col("canonical_url").isNull(), none),
        ("missing_schema", "onpage", "low", server & (F.size("schema_types") == 0), none),
        ("incomplete_og", "onpage", "low", server & ~F.col("og_complete"), none),
        ("images_missing_alt", "onpage", "medium", F.col("images_missing_alt") > 0, n("images_missing_alt"), n("images_missing_alt")),
        ("deep_page", "onpage", "medium", F.col("depth") > DEEP, n("depth"), n("depth")),
        ("thin_content", "onpage", "medium", server & (F.col("word_count") < MIN_WORDS), n("word_count")),
        ("missing_viewport", "onpage", "high", F.col("viewport").isNull(), none),
        ("missing_lang", "onpage", "low", F.col("lang").isNull(), none),
        ("images_missing_dimensions", "cwv", "medium", F.col("images_missing_dimensions") > 0, n("images_missing_dimensions"), n("images_missing_dimensions")),
    ]
    return _emit(pages.where(evaluable()), rules)


def duplicate_members(pages: DataFrame, key: Column) -> DataFrame:
    """client, run_id, k, url, n: the pages of every group that shares a non-empty key, a row each, and the group's size. A page's
    siblings are the other rows of its group."""
    keyed = pages.where(evaluable()).select(*KEYS, "seq", "url", key.alias("k")).where("k is not null and k <> ''")
    groups = keyed.groupBy(*KEYS, "k").agg(F.count(F.lit(1)).alias("n"))
    return keyed.join(groups.where("n > 1"), [*KEYS, "k"])


def duplicates(pages: DataFrame, key: Column, rule: str, severity: str) -> DataFrame:
    """A finding for every page that shares a non-empty key with another; its evidence is the group's size and first pages."""
    shared = duplicate_members(pages, key)
    return _emit(shared, [(rule, "onpage", severity, F.lit(True), F.concat_ws(" ", F.col("n").cast("string"), F.col("k")), F.col("n"))])


def duplicate_titles(pages: DataFrame) -> DataFrame:
    return duplicates(pages, F.col("title"), "duplicate_title", "medium")


def duplicate_h1s(pages: DataFrame) -> DataFrame:
    return duplicates(pages, F.get("h1s", F.lit(0)), "duplicate_h1", "low")


def missing_hreflang(pages: DataFrame) -> DataFrame:
    """One finding for a run whose pages have two locale prefixes or more and no hreflang anywhere."""
    rows = pages.where(evaluable()).select(*KEYS, F.nullif(locale_prefix(F.col("url")), F.lit("")).alias("locale"), (F.size("hreflangs") + F.size("header_hreflangs") > 0).alias("has"))
    site = rows.groupBy(*KEYS).agg(F.count_distinct("locale").alias("locales"), F.bool_or("has").alias("has")).withColumn("url", F.lit(None).cast("string"))
    return _emit(site, [("missing_hreflang_site", "onpage", "medium", (F.col("locales") >= 2) & ~F.col("has"), F.col("locales").cast("string"))])


def aliases(pages: DataFrame, key=None) -> DataFrame:
    """Pages by the URL asked for and the URL they ended at; the last page of an alias wins."""
    named = pages.withColumn("alias", F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url")))))
    named = named if key is None else named.withColumn("alias", key(F.col("alias")))
    return first_by(named, [*KEYS, "alias"], [F.desc("seq")])


def links(pages: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Broken links, links to redirects, orphan pages. edges: client, run_id, source_url, target_url and, if
    known, the source page's seq; seeds: client, run_id, url."""
    target = aliases(pages).select(*KEYS, F.col("alias").alias("target_url"), "fetch_error", "status_code")
    broken = edges.join(target, [*KEYS, "target_url"]).withColumn("url", F.col("source_url"))
    why = F.coalesce("fetch_error", F.col("status_code").cast("string"))
    broken = _emit(broken, [("broken_link", "links", "high", failed(F.col("fetch_error"), F.col("status_code")), F.concat_ws(" ", "target_url", why), why)])
    moved = pages.where("final_url is not null and final_url <> url").select(*KEYS, F.col("url").alias("target_url"), "final_url")
    moved = edges.join(moved, [*KEYS, "target_url"]).withColumn("url", F.col("source_url"))
    moved = _emit(moved, [("link_to_redirect", "links", "low", F.lit(True), F.concat_ws(" ", "target_url", "final_url"))])
    linked = edges.select(*KEYS, F.col("target_url").alias("url")).distinct()
    alone = pages.where(evaluable()).join(linked, [*KEYS, "url"], "left_anti").join(linked.withColumnRenamed("url", "final_url"), [*KEYS, "final_url"], "left_anti").join(seeds, [*KEYS, "url"], "left_anti")
    alone = _emit(alone, [("orphan_page", "links", "medium", F.lit(True), F.lit(""))])
    return broken.unionByName(moved).unionByName(alone)


def redirects(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Chains, loops, and temporary redirects of URLs in the sitemap. sitemap: client, run_id, url."""
    hops = F.coalesce(F.size("redirect_statuses"), F.lit(0))
    own = _emit(pages, [
        ("redirect_chain", "links", "medium", hops > 1, hops.cast("string"), hops),
        ("redirect_loop", "links", "critical", F.col("redirect_loop"), F.lit("")),
    ])
    temporary = pages.join(sitemap, [*KEYS, "url"], "left_semi")
    found = F.exists("redirect_statuses", lambda s: s.isin(302, 307))
    return own.unionByName(_emit(temporary, [("temp_redirect_in_sitemap", "links", "low", found, F.lit(""))]))


def _listed(rows: DataFrame, rule: str) -> DataFrame:
    """One finding a run: how many URLs, and the first of them."""
    order = Window.partitionBy(*KEYS).orderBy("url")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PREVIEW)
    total = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"))
    shown = first.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list("url")), ", ").alias("shown")).join(total, [*KEYS])
    more = F.when(F.col("total") > PREVIEW, F.concat(F.lit(" (+"), (F.col("total") - PREVIEW).cast("string"), F.lit(")"))).otherwise("")
    return _emit(shown.withColumn("url", F.lit(None).cast("string")), [(rule, "indexing", "low", F.lit(True), F.concat(F.col("total").cast("string"), F.lit(": "), F.col("shown"), more), F.col("total"))])


def crawlability(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Sitemap against crawl, noindex, content types, mixed content. A run without sitemap gets that finding alone of the first kind."""
    runs = pages.select(*KEYS).distinct()
    absent = _emit(runs.join(sitemap.select(*KEYS).distinct(), [*KEYS], "left_anti").withColumn("url", F.lit(None).cast("string")), [("no_sitemap", "indexing", "medium", F.lit(True), F.lit(""))])
    own = _emit(pages, [
        ("http_noindex", "indexing", "critical", F.contains(F.lower("x_robots_tag"), F.lit("noindex")), F.col("x_robots_tag")),
        ("content_type_not_html", "indexing", "low", F.col("content_type").isNotNull() & ~F.contains(F.lower("content_type"), F.lit("html")), F.col("content_type")),
        ("mixed_content", "indexing", "high", F.startswith("url", F.lit("https://")) & (F.col("mixed_content") > 0), F.col("mixed_content").cast("string"), F.col("mixed_content")),
    ])
    named = pages.where(noindexed()).withColumn("alias", F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url")))))
    hidden = named.join(sitemap.withColumnRenamed("url", "alias"), [*KEYS, "alias"], "left_semi").dropDuplicates([*KEYS, "url", "seq"])
    hidden = _emit(hidden, [("noindex_in_sitemap", "indexing", "high", F.lit(True), F.lit(""))])
    crawled = pages.select(*KEYS, F.explode(F.array_compact(F.array("url", "final_url"))).alias("url")).distinct()
    unseen = _listed(sitemap.distinct().join(crawled, [*KEYS, "url"], "left_anti"), "sitemap_not_crawled")
    listed_runs = sitemap.select(*KEYS).distinct()
    unlisted = pages.where(evaluable()).select(*KEYS, "url").join(listed_runs, [*KEYS]).join(sitemap, [*KEYS, "url"], "left_anti")
    unlisted = _listed(unlisted, "crawled_not_in_sitemap")
    out = absent
    for part in (own, hidden, unseen, unlisted):
        out = out.unionByName(part)
    return out


def canonicals(pages: DataFrame) -> DataFrame:
    """What a page's canonical leads to, and noindexed pages that others name as theirs."""
    target = aliases(pages, canonical_url_key).select(
        *KEYS, F.col("alias").alias("key"), F.col("url").alias("t_url"), F.col("final_url").alias("t_final"), F.col("fetch_error").alias("t_error"), F.col("status_code").alias("t_status"),
        F.coalesce(F.size("redirect_statuses"), F.lit(0)).alias("t_hops"), F.col("canonical_url").alias("t_canonical"), noindexed().alias("t_noindex"),
    )
    named = pages.where("canonical_url is not null").withColumn("key", canonical_url_key(F.col("canonical_url")))
    pairs = named.where(evaluable()).join(target, [*KEYS, "key"])
    own = _emit(pairs, [
        ("canonical_unreachable", "indexing", "critical", failed(F.col("t_error"), F.col("t_status")), F.concat_ws(" ", "t_url", F.coalesce("t_error", F.col("t_status").cast("string")))),
        ("canonical_redirects", "indexing", "high", F.col("t_hops") > 0, F.concat_ws(" ", "t_url", "t_final")),
        ("canonical_chain", "indexing", "high", canonical_url_key(F.col("t_canonical")) != canonical_url_key(F.col("t_url")), F.concat_ws(" ", "t_url", "t_canonical")),
        ("canonical_to_noindex", "indexing", "high", F.col("t_noindex"), F.col("t_url")),
    ])
    hidden = pages.where(noindexed()).select(*KEYS, "seq", "url", canonical_url_key(F.col("url")).alias("key"))
    incoming = hidden.join(named.select(*KEYS, "key", F.col("url").alias("from")), [*KEYS, "key"]).where("from <> url").groupBy(*KEYS, "url", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("from").alias("first"))
    incoming = _emit(incoming, [("noindex_receives_canonicals", "indexing", "high", F.lit(True), F.concat_ws(" ", F.col("n").cast("string"), "first"))])
    foreign = _emit(pages.where(evaluable()), [("canonical_cross_domain", "indexing", "low", url_host(F.col("canonical_url")) != url_host(F.col("url")), F.col("canonical_url"))])
    return own.unionByName(incoming).unionByName(foreign)


def schema_fields(blocks: DataFrame) -> DataFrame:
    """Structured-data blocks that lack required keys. blocks: client, run_id, url, type, keys, of pages that can be trusted."""
    required = F.create_map(*(x for k, names in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))
    missing = F.array_except(F.element_at(required, F.col("type")), F.col("keys"))
    rows = blocks.withColumn("missing", missing).where(F.size("missing") > 0)
    lack = F.concat_ws(" ", "type", F.array_join("missing", ","))
    return _emit(rows, [("schema_required_fields", "onpage", "medium", F.lit(True), lack, lack)])


# Indexing states and what stops indexing there.
BLOCKED = {
    "BLOCKED_BY_META_TAG": "robots meta tag",
    "BLOCKED_BY_HTTP_HEADER": "X-Robots-Tag header",
    "BLOCKED_BY_ROBOTS_TXT": "robots.txt",
}


def indexing(status: DataFrame) -> DataFrame:
    """What the index says of a URL. status: url, indexing_state, page_fetch_state, google_canonical, user_canonical."""
    cause = F.element_at(F.create_map(*(F.lit(x) for kv in BLOCKED.items() for x in kv)), F.col("indexing_state"))
    return _emit(status, [
        ("indexing_blocked", "indexing", "critical", ~F.col("indexing_state").isin("INDEXING_ALLOWED", "INDEXING_STATE_UNSPECIFIED"), F.coalesce(cause, F.col("indexing_state"))),
        ("fetch_failed", "indexing", "critical", ~F.col("page_fetch_state").isin("SUCCESSFUL", "PAGE_FETCH_STATE_UNSPECIFIED"), F.col("page_fetch_state")),
        ("canonical_rejected", "indexing", "critical", F.col("google_canonical") != F.col("user_canonical"), F.concat_ws(" ", "user_canonical", "google_canonical")),
    ])
