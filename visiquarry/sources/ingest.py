"""Landed JSON to tables. Every reader takes (client, run_id, ..., payload) rows and gives typed rows.

``split`` parts a reader's input into rows that can be read and rejects with a reason, so that a bad payload is kept as such.
A payload that is no JSON reads as null fields and is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import root_domain, tr_normalize
from ..functions.urls import url_path
from ..operators.findings import finding
from ..operators.keys import KEYS, first_by, round_half_up

TOP_N = 10
EXCERPT = 300


def split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason against them, and rejects with it."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select(*KEYS, "payload", "reason")


def _read(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("j", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))


# -- result pages

SERP = "struct<error:string,organic_results:array<struct<position:int,link:string>>,answer_box:string,ai_overview:string>"


def serp(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyword, position, domain, url and flags of the first ten results (the place in the list counts), and rejects."""
    read = _read(rows, SERP)
    reason = F.when(F.col("j").isNull(), "schema").when(F.col("j.error").isNotNull(), F.col("j.error")).when(F.col("j.organic_results").isNull(), "no organic_results")
    good, bad = split(read, reason)
    out = good.select(*KEYS, "keyword", F.col("j.answer_box").isNotNull().alias("has_featured_snippet"), F.col("j.ai_overview").isNotNull().alias("has_ai_overview"), F.posexplode(F.slice("j.organic_results", 1, TOP_N)).alias("at", "r"))
    return out.select(*KEYS, "keyword", (F.col("at") + 1).alias("position"), root_domain(F.col("r.link")).alias("domain"), F.col("r.link").alias("url"), "has_featured_snippet", "has_ai_overview"), bad


# -- keyword metrics, backlinks, gaps: one envelope

ENVELOPE = "struct<status_code:int,status_message:string,tasks:array<struct<status_code:int,status_message:string,result:array<string>>>>"
OK = 20000


def envelope(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with ``result`` (JSON texts of the first task), and rejects with code and message."""
    read = _read(rows, ENVELOPE).withColumn("t", F.get("j.tasks", F.lit(0)))
    fault = lambda c: F.concat_ws(" ", F.col(f"{c}.status_code").cast("string"), f"{c}.status_message")
    reason = F.when(F.col("j.status_code").isNull(), "schema").when(F.col("j.status_code") != OK, fault("j")).when(F.col("t").isNull(), "no task").when(F.coalesce(F.col("t.status_code"), F.lit(0)) != OK, fault("t"))
    good, bad = split(read, reason)
    return good.withColumn("result", F.coalesce("t.result", F.array().cast("array<string>"))).drop("j", "t", "payload"), bad


def keyword_difficulty(index: Column, label: Column) -> Column:
    level = F.upper(label)
    named = F.when(level == "LOW", 0.25).when(level == "MEDIUM", 0.5).when(level == "HIGH", 0.85).otherwise(0.0)
    return F.when(index.isNotNull(), F.greatest(F.least(index / 100, F.lit(1.0)), F.lit(0.0))).otherwise(named)


def keyword_metrics(requested: DataFrame, good: DataFrame) -> DataFrame:
    """Every requested keyword with its figures, 0 where the response lacks it; of repeated items the last counts."""
    items = good.select(*KEYS, F.posexplode("result").alias("at", "item"))
    item = F.from_json("item", "struct<keyword:string,search_volume:bigint,competition:string,competition_index:double,cpc:double>")
    items = items.withColumn("i", item).withColumn("kw", tr_normalize(F.col("i.keyword")))
    last = first_by(items, [*KEYS, "kw"], [F.desc("at")]).select(*KEYS, "kw", F.col("i.search_volume").alias("v"), keyword_difficulty(F.col("i.competition_index"), F.col("i.competition")).alias("d"), F.col("i.cpc").alias("c"))
    out = requested.withColumn("kw", tr_normalize(F.col("keyword"))).join(last, [*KEYS, "kw"], "left")
    return out.select(*KEYS, "keyword", F.coalesce("v", F.lit(0)).alias("volume"), F.coalesce("d", F.lit(0.0)).alias("difficulty"), F.coalesce("c", F.lit(0.0)).alias("cpc"))


def backlinks(good: DataFrame) -> DataFrame:
    """One profile per requested domain; the rank's tenth is its authority."""
    item = F.from_json(F.get("result", F.lit(0)), "struct<referring_domains:bigint,backlinks:bigint,rank:double>")
    out = good.withColumn("i", item).where("i is not null")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*KEYS, "domain", zero("i.referring_domains").alias("ref_domains"), zero("i.backlinks").alias("backlink_count"), (zero("i.rank") / 10).alias("domain_authority"))


def keyword_gaps(good: DataFrame) -> DataFrame:
    """Keywords for which the rival ranks and the client does not. A rank that is JSON null counts as one, as an absent one does not."""
    whole = F.try_parse_json(F.get("result", F.lit(0)))
    items = good.select(*KEYS, "competitor_domain", F.explode(F.from_json(F.to_json(F.variant_get(whole, "$.items", "variant")), "array<string>")).alias("item"))
    v = items.withColumn("v", F.try_parse_json("item"))
    own = F.variant_get("v", "$.first_domain_serp_element", "variant")
    ranks = own.isNotNull() & ~F.coalesce(F.is_variant_null(own), F.lit(False)) & F.variant_get("v", "$.first_domain_serp_element.rank_absolute", "variant").isNotNull()
    rival = F.try_variant_get("v", "$.second_domain_serp_element.rank_absolute", "int")
    keyword = F.try_variant_get("v", "$.keyword_data.keyword", "string")
    return v.where(keyword.isNotNull() & ~ranks & rival.isNotNull()).select(*KEYS, keyword.alias("keyword"), "competitor_domain", rival.alias("competitor_position"), F.try_variant_get("v", "$.keyword_data.keyword_info.search_volume", "bigint").alias("volume"))


# -- search performance, index status, field vitals


def reporting_window(now: Column) -> dict[str, Column]:
    """28 days that end three days before now."""
    end = F.date_sub(now, 3)
    return {"start_date": F.date_sub(end, 27), "end_date": end}


def search_performance(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = _read(rows, "struct<rows:array<struct<keys:array<string>,clicks:bigint,impressions:bigint,ctr:double,position:double>>>")
    good, bad = split(read, F.when(F.col("j").isNull(), "schema"))
    out = good.select(*KEYS, F.explode("j.rows").alias("r")).select(*KEYS, F.get("r.keys", F.lit(0)).alias("query"), F.get("r.keys", F.lit(1)).alias("page"), "r.clicks", "r.impressions", F.round("r.ctr", 4).alias("ctr"), F.col("r.position").alias("avg_position"))
    return out.where("query is not null and page is not null"), bad


INDEX = "coverageState robotsTxtState indexingState pageFetchState googleCanonical userCanonical lastCrawlTime".split()


def index_status(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = _read(rows, "struct<inspectionResult:struct<indexStatusResult:struct<" + ",".join(f"{n}:string" for n in INDEX) + ">>>")
    good, bad = split(read, F.when(F.col("j.inspectionResult.indexStatusResult").isNull(), "no indexStatusResult"))
    r = lambda n: F.col(f"j.inspectionResult.indexStatusResult.{n}")
    return good.select(
        *KEYS, "url", F.coalesce(r("coverageState"), F.lit("bilinmiyor")).alias("coverage_state"), F.coalesce(r("robotsTxtState"), F.lit("ROBOTS_TXT_STATE_UNSPECIFIED")).alias("robots_txt_state"),
        F.coalesce(r("indexingState"), F.lit("INDEXING_STATE_UNSPECIFIED")).alias("indexing_state"), F.coalesce(r("pageFetchState"), F.lit("PAGE_FETCH_STATE_UNSPECIFIED")).alias("page_fetch_state"),
        r("googleCanonical").alias("google_canonical"), r("userCanonical").alias("user_canonical"), F.to_timestamp(r("lastCrawlTime")).alias("last_crawl_time"),
    ), bad


def field_cwv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """75th percentiles of a URL or origin, numbers or texts; a metric that is absent is null."""
    metric = "struct<percentiles:struct<p75:string>>"
    read = _read(rows, f"struct<record:struct<metrics:struct<largest_contentful_paint:{metric},interaction_to_next_paint:{metric},cumulative_layout_shift:{metric}>>>")
    good, bad = split(read, F.when(F.col("j.record.metrics").isNull(), "no metrics"))
    p = lambda n: F.col(f"j.record.metrics.{n}.percentiles.p75").try_cast("double")
    return good.select(*KEYS, "url", F.lit("PHONE").alias("form_factor"), p("largest_contentful_paint").alias("lcp_ms"), p("interaction_to_next_paint").alias("inp_ms"), p("cumulative_layout_shift").alias("cls")), bad


def with_origin_fallback(requested: DataFrame, by_url: DataFrame, by_origin: DataFrame) -> DataFrame:
    """A URL's own record, else its origin's under the URL asked for, else nothing. by_origin: url is the origin."""
    figures = lambda df: F.struct(*(df[c] for c in ("form_factor", "lcp_ms", "inp_ms", "cls")))
    own = by_url.select(*KEYS, "url", figures(by_url).alias("own"))
    origin = by_origin.select(*KEYS, F.col("url").alias("origin"), figures(by_origin).alias("wide"))
    out = requested.withColumn("origin", F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)).join(own, [*KEYS, "url"], "left").join(origin, [*KEYS, "origin"], "left")
    return out.withColumn("f", F.coalesce("own", "wide")).where("f is not null").select(*KEYS, "url", "f.*")


# -- lab audits

AUDITS = "map<string,struct<score:double,numericValue:double,explanation:string,details:string>>"
LAB = f"struct<requestedUrl:string,finalDisplayedUrl:string,categories:struct<performance:struct<score:double>,seo:struct<score:double>>,audits:{AUDITS}>"
NODE = "struct<type:string,selector:string,snippet:string>"
ITEMS = f"struct<items:array<struct<type:string,selector:string,snippet:string,score:double,node:{NODE},url:string,totalBytes:double,wastedBytes:double,subItems:struct<items:array<struct<reason:string>>>,items:array<struct<subpart:string,duration:double>>>>>"

# Audits of which a score of 0 is a finding, and how grave it is.
SEO_AUDITS = {
    "is-crawlable": "critical", "document-title": "high", "meta-description": "medium", "http-status-code": "critical", "link-text": "low",
    "crawlable-anchors": "high", "robots-txt": "high", "image-alt": "medium", "hreflang": "medium", "canonical": "high",
}


def _items(name: str) -> Column:
    return F.from_json(F.element_at("audits", name)["details"], ITEMS)["items"]


def lab_audit(rows: DataFrame, wrapper: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One audit per payload with its LCP phases and largest shift; LCP and CLS are required, INP cannot be measured and is 0."""
    given = rows if wrapper is None else rows.withColumn("payload", F.get_json_object("payload", f"$.{wrapper}"))
    read = _read(given, LAB).withColumn("audits", F.col("j.audits"))
    number = lambda n: F.element_at("audits", n)["numericValue"]
    lcp, cls = number("largest-contentful-paint"), number("cumulative-layout-shift")
    good, bad = split(read, F.when(F.col("j.audits").isNull(), "schema").when(lcp.isNull() | cls.isNull(), "core metrics missing"))
    breakdown = _items("lcp-breakdown-insight")
    parts = F.flatten(F.transform(breakdown, lambda i: F.coalesce(i["items"], F.array().cast("array<struct<subpart:string,duration:double>>"))))
    phase = lambda n: F.coalesce(F.array_max(F.transform(F.filter(parts, lambda p: p["subpart"] == n), lambda p: p["duration"])), F.lit(0.0))
    node = F.get(F.filter(breakdown, lambda i: i["type"] == "node"), F.lit(0))
    resource = F.exists(parts, lambda p: p["subpart"].isin("resourceLoadDelay", "resourceLoadDuration"))
    attribution = F.struct(
        node["selector"].alias("target"), F.when(resource, F.nullif(F.regexp_extract(node["snippet"], 'src="([^"]+)"', 1), F.lit(""))).alias("url"),
        *(phase(n).alias(n) for n in ("timeToFirstByte", "resourceLoadDelay", "resourceLoadDuration", "elementRenderDelay")),
    )
    shifts = F.transform(_items("layout-shifts"), lambda i, at: F.struct(F.coalesce(i["score"], F.lit(0.0)).alias("score"), (-at).alias("at"), i["node"]["selector"].alias("selector")))
    largest = F.array_max(shifts)
    points = lambda c: round_half_up(F.col(c) * 100)
    return good.select(
        *KEYS, F.coalesce("j.finalDisplayedUrl", "j.requestedUrl", F.lit("")).alias("url"), lcp.alias("lcp_ms"), F.lit(0.0).alias("inp_ms"), cls.alias("cls"),
        F.coalesce(points("j.categories.performance.score"), F.lit(0)).alias("performance_score"), points("j.categories.seo.score").alias("seo_score"),
        F.when(F.size(parts) > 0, attribution).alias("lcp"), F.lit(None).cast("struct<inputDelay:double,processingDuration:double,presentationDelay:double>").alias("inp"),
        F.when(largest.isNotNull(), F.struct(largest["selector"].alias("largestShiftTarget"), largest["score"].alias("largestShiftValue"), F.lit(0).alias("largestShiftTime"), F.lit("loading").alias("loadState"))).alias("shift"), "audits",
    ), bad


def seo_findings(audits: DataFrame) -> DataFrame:
    """Findings of the ten page audits whose score is 0; evidence is the explanation, else the number of elements, else the name."""
    made = []
    for name, severity in SEO_AUDITS.items():
        own = F.element_at("audits", name)
        n = F.size(_items(name))
        evidence = F.coalesce(own["explanation"], F.when(n > 0, F.concat(n.cast("string"), F.lit(" elements"))), F.lit(name))
        made.append(F.when(own["score"] == 0, finding(name, "onpage", severity, F.col("url"), evidence)))
    return audits.select(*KEYS, F.explode(F.array_compact(F.array(*made))).alias("f")).select(*KEYS, "f.*")


def lab_issues(audits: DataFrame) -> DataFrame:
    """url, kind, subject, bytes: images that could be smaller, resources that block rendering, latency checks that failed."""
    row = lambda kind, subject, size: F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), size.cast("double").alias("bytes"))
    none = F.array().cast("array<struct<kind:string,subject:string,bytes:double>>")
    images = F.transform(F.filter(_items("image-delivery-insight"), lambda i: i["url"].isNotNull() & i["totalBytes"].isNotNull()), lambda i: row("image", i["url"], i["totalBytes"]))
    blocking = F.transform(F.filter(_items("render-blocking-insight"), lambda i: i["url"].isNotNull()), lambda i: row("render_blocking", i["url"], i["totalBytes"]))
    checks = F.map_values(F.from_json(F.get_json_object(F.element_at("audits", "document-latency-insight")["details"], "$.items"), "map<string,struct<label:string,value:boolean>>"))
    latency = F.transform(F.filter(checks, lambda c: ~c["value"] & c["label"].isNotNull()), lambda c: row("latency", c["label"], F.lit(None)))
    every = F.concat(F.coalesce(images, none), F.coalesce(blocking, none), F.coalesce(latency, none))
    return audits.select(*KEYS, "url", F.explode(every).alias("i")).select(*KEYS, "url", "i.*")


# -- answers of language models

ANSWER = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>,promptFeedback:struct<blockReason:string>,error:struct<status:string,message:string>>"


def ai_answers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query, model, sample_index, text, excerpt: the first candidate's parts put together; errors, blocks and empty answers are rejects."""
    parts = F.get("j.candidates", F.lit(0))["content"]["parts"]
    text = F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), r"^\s+|\s+$", "")
    read = _read(rows, ANSWER).withColumn("text", F.coalesce(text, F.lit("")))
    reason = F.when(F.col("j").isNull(), "schema").when(F.col("j.error").isNotNull(), "error").when(F.col("j.promptFeedback.blockReason").isNotNull(), "blocked").when(F.col("text") == "", "empty")
    good, bad = split(read, reason)
    return good.select(*KEYS, "query", "model", "sample_index", "text", F.substring("text", 1, EXCERPT).alias("answer_excerpt")), bad


# -- robots, sitemaps, redirects


def robots_rules(files: DataFrame) -> DataFrame:
    """host, agent, allow, path from robots files (host, content): a rule belongs to the agents named just before its group."""
    lines = files.select("host", F.posexplode(F.split(F.regexp_replace("content", r"#[^\r\n]*", ""), r"\r?\n")).alias("at", "line"))
    field, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    lines = lines.select("host", "at", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("at")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("group", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    agents = lines.where("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent")).distinct()
    rules = lines.where("field <> 'user-agent' and value <> ''").select("host", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, ["host", "group"]).select("host", "agent", "allow", "path")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls (host, url) with allowed: the longest matching rule of the agent wins, of equal ones the permission; no rule allows.
    On hosts that have no group for the agent, the rules of ``*`` hold.

    A rule is found by its literal start, up to its first sign: a path is cut at the lengths that its host's rules have, and
    these starts meet the rules' own, so that only rules whose start agrees are compared as patterns.
    """
    named = rules.where(F.col("agent") == agent.lower())
    own = named.unionByName(rules.where("agent = '*'").join(named.select("host").distinct(), "host", "left_anti"))
    special = F.replace(F.regexp_replace("path", r"([.+?^{}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    own = own.withColumns({"pattern": F.concat(F.lit("^"), special), "start": F.regexp_extract("path", "^[^*$]*", 0)})
    lengths = own.groupBy("host").agg(F.collect_set(F.length("start")).alias("lengths"))
    asked = urls.select("host", "url", url_path(F.col("url")).alias("asked")).join(lengths, "host")
    cut = asked.select("host", "url", "asked", F.explode(F.filter("lengths", lambda n: n <= F.length("asked"))).alias("n"))
    hit = cut.withColumn("start", F.left("asked", F.col("n"))).join(own, ["host", "start"]).where(F.regexp_like("asked", F.col("pattern")))
    best = hit.groupBy("host", "url").agg(F.max_by("allow", F.struct(F.length("path"), F.col("allow"))).alias("allowed"))
    return urls.join(best, ["host", "url"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def sitemap_addresses(hosts: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared sitemaps of each host, /sitemap.xml where it declares none. declared: host, sitemap."""
    absent = hosts.select("host").distinct().join(declared, "host", "left_anti").select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("sitemap"))
    return declared.select("host", "sitemap").unionByName(absent).dropDuplicates()


def redirect_chains(hops: DataFrame, max_hops: int = 5) -> DataFrame:
    """One row per requested URL from its hop log (url, hop, hop_url, status_code, location): statuses in order, the final URL, loop."""
    kept = hops.where(F.col("hop") <= max_hops)
    rows = kept.groupBy(*KEYS, "url").agg(F.sort_array(F.collect_list(F.struct("hop", "hop_url", "status_code", "location"))).alias("h"))
    places = F.concat(F.transform("h", lambda x: x["hop_url"]), F.array(F.element_at("h", -1)["location"]))
    return rows.select(*KEYS, "url", F.transform("h", lambda x: x["status_code"]).alias("redirect_statuses"), F.coalesce(F.element_at("h", -1)["location"], F.col("url")).alias("final_url"), (F.size(F.array_distinct(places)) < F.size(places)).alias("redirect_loop"))
