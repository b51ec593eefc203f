"""Small frames for the edges that the given tables do not reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from visiquarry.functions import text as T
from visiquarry.functions import urls as U
from visiquarry.operators import ai, audit, codeaudit, diff, findings, graph, keywords, ranking, runs, search, vitals
from visiquarry.sources import configs, ingest, markup, source_tree
from visiquarry.sources.html_pages import extract, parse_page
from visiquarry.streaming import rum


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_turkish_case_and_spaces(spark):
    rows = [("İSTANBUL IŞIK",), ("  Ayakkabı ",), (None,)]
    assert values(spark, rows, "k string", T.tr_normalize(F.col("k"))) == ["istanbul ışık", "ayakkabı", None]
    assert values(spark, [("Şık Çanta & Gömlek!",)], "k string", T.slugify(F.col("k"))) == ["sik-canta-gomlek"]


def test_intents_and_clusters(spark):
    none = F.array(F.lit("acme")).cast("array<string>")
    rows = [("acme fiyat",), ("ankara kargo",), ("ucuz çanta",), ("çanta nedir",), ("çanta",), ("en",)]
    assert values(spark, rows, "k string", T.classify_intent(F.col("k"), none)) == ["branded", "local", "commercial", "informational", "commercial", "commercial"]
    assert values(spark, [("kırmızı deri çanta",), ("en iyi",), ("aaaa bbbb",)], "k string", T.cluster_id(F.col("k"), F.lit("x"))) == ["kırmı-x", "genel-x", "aaaa-x"]


def test_canonical_keys(spark):
    rows = [("https://www.A.com/x/index.html#f",), ("http://a.com/x",), ("https://a.com/x/?b=2&a=1",), ("/relative",), ("https://a.com",), ("https://a.com:8080/",)]
    got = values(spark, rows, "u string", U.canonical_url_key(F.col("u")))
    assert got[0] == got[1] == "a.com/x"
    assert got[2:] == ["a.com/x?a=1&b=2", "/relative", "a.com/", "a.com:8080/"]


def test_page_fields():
    html = (
        '<html lang="tr"><head><title> A &amp; B </title><meta name="description" content=""><link rel="canonical" href="/c"><meta name="robots" content="noindex">'
        '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i"><meta name="viewport" content="w">'
        '<link rel="alternate" hreflang=" de " href="x"><script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"],"name":"n","offers":[{"@type":"Offer","price":1}]}]}</script>'
        '<script type="application/ld+json">{bad</script></head><body><h1>One <b>two</b></h1><h2>x</h2><img src="http://x/y.png"><img alt="" width=1 height=2>'
        '<a href="/p#q">in</a><a href="https://other.com/">out</a><a href="mailto:a@b">m</a><a href="#top">t</a>  many   words here</body></html>'
    )
    p = parse_page(html, "https://site.com/dir/page")
    assert (p["title"], p["meta_description"], p["canonical_href"], p["robots"], p["lang"], p["viewport"]) == ("A & B", "", "/c", "noindex", "tr", "w")
    assert (p["h1s"], p["heading_order"], p["og_complete"], p["hreflangs"]) == (["One two"], ["h1", "h2"], True, ["de"])
    assert [b["type"] for b in p["schema_blocks"]] == ["Product", "Thing"] and p["schema_blocks"][0]["keys"] == ["name", "offers", "offers.price"]
    assert p["links"] == [{"target_url": "https://site.com/p#q", "anchor_text": "in"}] and p["external_links"] == 1
    assert (p["images_missing_alt"], p["images_missing_dimensions"], p["mixed_content"]) == (1, 1, 1)
    assert parse_page(None, None)["h1s"] == []


def page(**over):
    own = dict(client="c", run_id=1, seq=1, url="https://a.com/", final_url="https://a.com/", status_code=200, fetch_error=None, title="t", meta_description="d", canonical_url="https://a.com/", h1s=["h"], schema_types=["X"], og_complete=True, images_missing_alt=0, images_missing_dimensions=0, word_count=500, depth=0, viewport="v", lang="tr", meta_robots=None, x_robots_tag=None, content_type="text/html", mixed_content=0, hreflangs=[], header_hreflangs=[], redirect_statuses=[], redirect_loop=False, is_client_rendered=False)
    return own | over


PAGE = "client string, run_id int, seq int, url string, final_url string, status_code int, fetch_error string, title string, meta_description string, canonical_url string, h1s array<string>, schema_types array<string>, og_complete boolean, images_missing_alt int, images_missing_dimensions int, word_count int, depth int, viewport string, lang string, meta_robots string, x_robots_tag string, content_type string, mixed_content int, hreflangs array<string>, header_hreflangs array<string>, redirect_statuses array<int>, redirect_loop boolean, is_client_rendered boolean"


def frame(spark, *rows):
    names = list(page())
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAGE)


def rules(df):
    return sorted(r.rule for r in df.collect())


def test_on_page_limits(spark):
    assert rules(audit.on_page(frame(spark, page(title="x" * 60, meta_description="y" * 160, word_count=150, depth=3)))) == []
    assert rules(audit.on_page(frame(spark, page(title="x" * 61, meta_description="y" * 161, word_count=149, depth=4)))) == ["deep_page", "meta_description_too_long", "thin_content", "title_too_long"]
    assert rules(audit.on_page(frame(spark, page(title=None, h1s=[], word_count=1, is_client_rendered=True)))) == ["client_rendered"]
    assert rules(audit.on_page(frame(spark, page(status_code=404, title=None), page(status_code=None)))) == []


def test_canonical_rules(spark):
    rows = [
        page(seq=1, url="https://a.com/1", final_url="https://a.com/1", canonical_url="https://www.a.com/2/"), page(seq=2, url="https://a.com/2", final_url="https://a.com/2", canonical_url="https://a.com/3", meta_robots="NoIndex"),
        page(seq=3, url="https://a.com/3", final_url="https://a.com/3", status_code=500, canonical_url=None), page(seq=4, url="https://a.com/4", final_url="https://a.com/4", canonical_url="https://b.com/"),
    ]
    got = {(r.rule, r.url[-1]) for r in audit.canonicals(frame(spark, *rows)).collect()}
    assert got == {("canonical_chain", "1"), ("canonical_to_noindex", "1"), ("canonical_unreachable", "2"), ("noindex_receives_canonicals", "2"), ("canonical_cross_domain", "4")}


def test_sitemap_rules(spark):
    p = frame(spark, page(url="https://a.com/1", final_url="https://a.com/1", mixed_content=1), page(seq=2, url="https://a.com/2", final_url="https://a.com/2", x_robots_tag="noindex"))
    none = spark.createDataFrame([], "client string, run_id int, url string")
    assert rules(audit.crawlability(p, none)) == ["http_noindex", "mixed_content", "no_sitemap"]
    listed = spark.createDataFrame([("c", 1, "https://a.com/2"), ("c", 1, "https://a.com/9")], "client string, run_id int, url string")
    assert rules(audit.crawlability(p, listed)) == ["crawled_not_in_sitemap", "http_noindex", "mixed_content", "noindex_in_sitemap", "sitemap_not_crawled"]


def test_required_keys(spark):
    rows = [("c", 1, "u", "FAQPage", ["mainEntity"]), ("c", 1, "u", "Product", ["name", "offers", "offers.price"]), ("c", 1, "u", "Other", [])]
    got = audit.schema_fields(spark.createDataFrame(rows, "client string, run_id int, url string, type string, keys array<string>")).collect()
    assert [r.evidence for r in got] == ["Product offers.priceCurrency,offers.availability"]


def test_collapsing_groups_of_three_and_four(spark):
    schema = "client string, run_id int, seq int, category string, title string, url string, evidence string, severity string, phase_share double"
    rows = [("c", 1, i, "a", f"{i} words", f"u{i}", "e", "low", None) for i in range(4)] + [("c", 1, 10 + i, "b", "same", f"v{i}", "e", "high", None) for i in range(3)] + [("c", 1, 20 + i, "d", "same", None if i == 0 else f"w{i}", "e", "high", None) for i in range(5)]
    got = findings.collapse_widespread(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 + 3 + 5
    assert [r.evidence for r in got if r.category == "a"] == ["4 pages (numbers differ): u0, u1, u2, u3"]
    placed = findings.cap_findings(spark.createDataFrame(rows, schema), 2).collect()
    assert len(placed) == 2 and placed[0].hidden == 7 and {r.severity for r in placed} == {"high"}


def test_ties_and_zero_impressions(spark):
    rows = [("c", 1, "q", "/a", 0), ("c", 1, "q", "/b", 0), ("c", 1, "r", "", 9), ("c", 1, "r", "/a", 10), ("c", 1, "r", "/b", 2), ("c", 1, "r", "/c", 1)]
    got = search.cannibalization(spark.createDataFrame(rows, "client string, run_id int, query string, page string, impressions long")).collect()
    assert [(r["query"], r["primary"], r.n_secondary, r.top_share) for r in got] == [("r", "/a", 1, 0.2)]
    kw = spark.createDataFrame([("c", 1, 1, "x", "i", "k", 5, 0.1, None), ("c", 1, 2, "y", "j", "k", 5, 0.3, 4)], "client string, run_id int, kw_id int, keyword string, intent string, cluster_id string, volume int, difficulty double, client_rank int")
    assert keywords.clusters(kw).first().representative == "x"


def test_percentile_of_known_samples(spark):
    schema = "client string, url string, metric string, value double, seq int"
    rows = [("c", "u", "LCP", 100.0 * (i + 1), i) for i in range(8)] + [("c", "v", "LCP", 1.0, i) for i in range(2)]
    slow = [("c", "w", "INP", v, i) for i, v in enumerate([100.0] * 8 + [5000.0] * 4)]
    got = {(r.url): r.value for r in rum.p75(spark.createDataFrame(rows + slow, schema)).collect()}
    assert got == {"u": 600.0, "w": 5000.0} or got == {"u": 600.0, "w": 100.0}
    assert got["u"] == 600.0 and "v" not in got


def test_payload_validation(spark):
    good = {"url": "https://a.com/", "metric": "LCP", "value": 1.5, "rating": "good", "attribution": '{"target":"h1","timeToFirstByte":"x"}'}
    rows = [[good], [good, good | {"metric": "X"}], [good | {"value": -1}], [], [good] * 51, [good | {"url": "no url"}]]
    beacons = spark.createDataFrame([(json.dumps(r), "c") for r in rows] + [("{bad", "c")], "payload string, client string")
    checked = rum.validate(beacons)
    assert [r.accepted for r in checked.collect()] == [True] + [False] * 6
    got = rum.samples(checked).select(rum.decode_attribution(F.col("metric"), F.col("attribution")).alias("a")).first()["a"]
    assert (got["target"], got["timeToFirstByte"], got["largestShiftValue"]) == ("h1", 0.0, None)


def test_origins(spark):
    beacons = spark.createDataFrame([("a", "https://a.com"), ("a", "https://x.com"), ("b", "https://y.com")], "client string, origin string")
    allowed = spark.createDataFrame([("a", "https://a.com")], "client string, origin string")
    assert sorted(tuple(r) for r in rum.allowed_origin(beacons, allowed).select("client", "origin").collect()) == [("a", "https://a.com"), ("b", "https://y.com")]


def test_crawl_waves_keep_to_site_exclusions_robots_and_budget(spark):
    edge = lambda client, source, *targets: [(client, 1, f"https://{client}.com/{source}", t if t is None or t.startswith("http") else f"https://{client}.com/{t}", i) for i, t in enumerate(targets)]
    rows = edge("a", "", "z", "b", "https://other.com/x", "hidden/1", "no/1", "no/yes", None, "b") + edge("a", "z", "b", "d") + edge("a", "b", "e", "", "c") + edge("a", "no/1", "lost") + edge("b", "", "hidden/1", "no/1") + edge("c", "", "x")
    edges = spark.createDataFrame(rows * 2, "client string, run_id int, source string, target string, position int")
    seeds = spark.createDataFrame([(c, 1, f"https://{c}.com/", 0) for c in "abc"] * 2, "client string, run_id int, url string, position int")
    sites = spark.createDataFrame([("a", "a.com", ["/hidden"]), ("b", "b.com", None)], "client string, domain string, excluded array<string>")
    rules = ingest.robots_rules(spark.createDataFrame([("a.com", "user-agent: *\ndisallow: /no\nallow: /no/y*s$")], "host string, content string"))
    crawl = lambda **limits: {(r.client, r.url.split(".com/")[1]): (r.depth, r.place) for r in graph.crawl_waves(edges, seeds, sites, rules, **limits).collect()}
    own = {("b", ""): (0, 1), ("b", "hidden/1"): (1, 2), ("b", "no/1"): (1, 3)}
    every = {("a", ""): (0, 1), ("a", "z"): (1, 2), ("a", "b"): (1, 3), ("a", "no/yes"): (1, 4), ("a", "d"): (2, 5), ("a", "e"): (2, 6), ("a", "c"): (2, 7)}
    assert crawl() == every | own
    assert crawl(budget=6) == {k: v for k, v in every.items() if v[1] <= 6} | own
    assert crawl(max_depth=1) == {k: v for k, v in every.items() if v[0] <= 1} | own
    assert graph.crawl_waves(edges.limit(0), seeds.limit(0), sites.limit(0), rules.limit(0)).count() == 0


def test_robots_rules_are_found_by_their_starts(spark):
    text = "User-agent: *\nDisallow: /\nAllow: /a\nDisallow: /a*b\nAllow: /a/c$\nDisallow: *.pdf"
    rules = ingest.robots_rules(spark.createDataFrame([("h", text)], "host string, content string"))
    want = {"/": False, "/a": True, "/ax": True, "/axb": False, "/a/c": True, "/a/cb": False, "/q": False, "/a/x.pdf": False, "": False}
    urls = spark.createDataFrame([("h", f"https://h{p}") for p in want] + [("free", "https://free/x.pdf")], "host string, url string")
    got = {r.url: r.allowed for r in ingest.robots_allowed(urls, rules).collect()}
    assert got == {f"https://h{p}": ok for p, ok in want.items()} | {"https://free/x.pdf": True}


def test_click_depth_with_budget(spark):
    edges = spark.createDataFrame([("c", 1, 0, i) for i in range(1, 6)] + [("c", 1, 1, 10), ("c", 1, 10, 0)], "client string, run_id int, source int, target int")
    seeds = spark.createDataFrame([("c", 1, 0)], "client string, run_id int, node int")
    assert {r.node: r.depth for r in graph.click_depth(edges, seeds).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 2}
    assert {r.node for r in graph.click_depth(edges, seeds, budget=3).collect()} == {0, 1, 2}


def test_source_rules(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "x.php").write_text("<head>")
    (tmp_path / "config.php").write_text("$db_password = 's3cretValue99';")
    (tmp_path / ".htaccess").write_text("RewriteEngine On")
    (tmp_path / "index.php").write_text('<html><head ></head><!-- <h1>old</h1> --><img src="a.png"><script src="https://t.com/x.js"></script><div id="hero">x</div>')
    files = codeaudit.read_files(codeaudit.scan(spark, {"c": str(tmp_path)}))
    got = {r.rel_path: r.content for r in files.collect()}
    assert set(got) == {"config.php", ".htaccess", "index.php"}
    assert "s3cretValue99" not in got["config.php"] and codeaudit.REDACTED in got["config.php"]
    stacks = codeaudit.detect_stack(files)
    assert stacks.first().stacks == ["php-custom"]
    assert set(rules(codeaudit.file_findings(files, stacks))) == {"legacy_images", "third_party_scripts", "no_cache_directive", "no_https_rule", "no_structured_data", "h1_only_in_comment"}
    made = spark.createDataFrame([("c", 1, "div#hero"), ("c", 1, "p")], "client string, run_id int, culprit_selector string")
    assert sorted((r.code_file, r.code_line) for r in codeaudit.link_findings(made, files).collect() if r.code_file) == [("index.php", 1)]


def test_vitals_edges(spark):
    f = spark.createDataFrame([(2500.0, 200.0, 0.1), (4000.0, 500.0, 0.25), (4001.0, 501.0, 0.26)], "l double, i double, c double")
    assert [tuple(r) for r in f.select(vitals.rate("LCP", F.col("l")), vitals.rate("INP", F.col("i")), vitals.rate("CLS", F.col("c"))).collect()] == [("good",) * 3, ("needs-improvement",) * 3, ("poor",) * 3]
    assert values(spark, [(0, 0)], "a int, b int", F.array(*vitals.phase_shares([F.col("a"), F.col("b")]))) == [[0.0, 0.0]]


def test_extract_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "https://a.com/", None), (2, None, "<title>x</title>")], "k int, url string, html string")
    got = extract(rows).orderBy("k").collect()
    assert got[0].title is None and got[1].title == "x" and got[0].word_count == 0


def test_every_source_rule_fires(spark):
    files = [
        ("p", "index.php", '<html><head><base href="/"><meta name="robots" content="a"><meta name="googlebot" content="b"><META NAME="ROBOTS" content="c">'
         '<meta property="og:title" content="x"><meta http-equiv="Pragma" content="no-cache"><meta name="rating" content="x"><meta name="audience" content="y"></head>'
         '<!-- <h1>old</h1> --><img src="a.JPG"><img loading="lazy" src=\'b.png\'><img src="c.png" data-x="c.webp"><script src="https://x.example/a.js"></script></html>'),
        ("p", ".htaccess", "RewriteRule ^([a-z]{2})/ index.php?lang=$1"), ("p", "old/a.html", "<p>x</p>"),
        ("n", "next.config.mjs", "export default {}"), ("n", "app/layout.tsx", "'use client'\nexport default function L() {}"),
        ("n", "app/[slug]/page.tsx", "import d from 'next/dynamic'\nconst X = dynamic(() => import('./x'), { ssr: false })\nexport const dynamic = 'force-dynamic'\nexport default () => <div><Image src={a > b ? c : d} /><img src={x}/></div>"),
        ("n", "lib/s.tsx", "<script>1</script><link href='https://fonts.googleapis.com/css'>"),
        ("ok", "next.config.js", ""), ("ok", "app/robots.ts", ""), ("ok", "app/page.tsx", "import Image from \"next/image\"\nexport const metadata: Metadata = { alternates: { canonical: '/' } }\n<Image priority src='a' />"),
    ]
    frame = spark.createDataFrame([(c, 1, p, t) for c, p, t in files], "client string, run_id int, rel_path string, content string")
    stacks = codeaudit.detect_stack(frame)
    assert {r.client: r.stacks for r in stacks.collect()} == {"p": ["php-custom"], "n": ["nextjs"], "ok": ["nextjs"]}
    got = codeaudit.file_findings(frame, stacks).unionByName(codeaudit.project_findings(frame, stacks)).collect()
    php = {"legacy_images", "third_party_scripts", "no_cache_directive", "no_https_rule", "robots_meta_conflict", "og_incomplete_source", "no_cache_pragma", "dead_meta", "base_href", "no_structured_data", "h1_only_in_comment", "public_dead_html", "missing_hreflang_source"}
    js = {"use_client_layout", "dynamic_ssr_false", "force_dynamic", "no_generate_static_params", "missing_metadata", "raw_img", "image_without_priority", "raw_script", "no_canonical_convention", "no_robots_sitemap_file", "no_next_font"}
    assert {r.rule for r in got if r.client == "p"} == php
    assert {r.rule for r in got if r.client == "n"} == js
    assert not [r for r in got if r.client == "ok"]
    assert {(r.rule, r.evidence) for r in got if r.rule == "legacy_images"} == {("legacy_images", "1/2")}


def test_findings_are_placed_in_attributes(spark):
    frame = spark.createDataFrame([("c", 1, "a.php", "ad banner text\n<div\n class='x ad-banner-2'>"), ("c", 1, "b.php", '<p id="hero">')], "client string, run_id int, rel_path string, content string")
    made = [("c", 1, "div.ad", None, None), ("c", 1, "main > p.ad-banner", None, None), ("c", 1, "x y#hero", None, None), ("c", 1, "p", None, None), ("c", 1, "p#hero", "kept.php", 7)]
    out = codeaudit.link_findings(spark.createDataFrame(made, "client string, run_id int, culprit_selector string, code_file string, code_line int"), frame)
    assert {(r.culprit_selector, r.code_file, r.code_line) for r in out.collect()} == {("div.ad", "a.php", 3), ("main > p.ad-banner", "a.php", 3), ("x y#hero", "b.php", 1), ("p", None, None), ("p#hero", "kept.php", 7)}


def test_configurations(spark):
    rows = [(1, '{"domain":"a.com","brandName":"A","brandTokens":["a"],"seedKeywords":["k"],"crawlMaxPages":7,"unknown":1}'), (2, None), (3, "[1]"), (4, '{"domain":5,"brandName":"","brandTokens":[],"seedKeywords":["k",null],"locale":null,"auditUrls":["x y"],"crawlMaxDepth":-1,"crawlEnabled":"no"}')]
    good, bad = configs.read(spark.createDataFrame(rows, "id int, payload string"))
    (one,) = good.collect()
    assert (one.domain, one.crawl_max_pages, one.crawl_max_depth, one.locale, one.mock_seed, one.crawl_enabled, one.ai_queries, one.code_path) == ("a.com", 7, 5, "tr-TR", 42, True, [], None)
    assert {r.id: r.errors for r in bad.collect()} == {2: ["json"], 3: ["json"], 4: ["domain", "brandName", "brandTokens", "seedKeywords", "auditUrls", "locale", "crawlMaxDepth", "crawlEnabled"]}


def test_first_of_repeated_rows(spark):
    rows = [("c", 1, "a", "b", 3, "foot"), ("c", 1, "a", "b", 1, "head"), ("c", 2, "a", "b", 2, None), ("c", 1, "a", "x", 5, "foot")]
    got = runs.first_rows(spark.createDataFrame(rows, "client string, run_id int, source_url string, target_url string, seq int, text string"), "page_links")
    assert {tuple(r) for r in got.collect()} == {rows[1], rows[2], rows[3]}
    assert got.columns == ["client", "run_id", "source_url", "target_url", "seq", "text"]


def test_titles_fold_their_numbers(spark):
    made = findings.all_findings(audit.on_page(frame(spark, *(page(seq=i, url=f"u{i}", h1s=["h"] * n, depth=4 + i) for i, n in enumerate((2, 3, 4, 12))))))
    assert {r.title for r in made.where("rule = 'multiple_h1'").collect()} == {f"multiple h1 ({n})" for n in (2, 3, 4, 12)}
    got = {r.rule: r.evidence for r in findings.collapse_widespread(made).where("url is null").collect()}
    assert got["multiple_h1"] == got["deep_page"] == "4 pages (numbers differ): u0, u1, u2, u3"
    fewer = findings.all_findings(audit.on_page(frame(spark, page(seq=0, url="u0", h1s=["h"] * 5, depth=9))))
    assert diff.findings_diff(made.where("url = 'u0'"), fewer).count() == 0


def test_runs_without_a_run_before(spark):
    rows = [("c", 1, "failed", "h"), ("c", 2, "completed", "h"), ("c", 3, "completed", None), ("c", 4, "running", "h")]
    got = diff.baselines(spark.createDataFrame(rows, "client string, run_id int, status string, config_hash string")).collect()
    assert {(r.run_id, r.previous_run, r.is_baseline, r.config_mismatch) for r in got} == {(1, None, True, False), (2, None, True, False), (3, 2, False, True), (4, 3, False, True)}


MARKUP = {
    '<img src="/a.png" style={{width: 10}} />': ("img", True, {"src": "/a.png", "style": "{{width: 10}}"}),
    "<img alt={`${t}`} src='a.jpg'>": ("img", True, {"alt": "{`${t}`}", "src": "a.jpg"}),
    "<img srcSet={`${a > b ? `x${c}` : '}'} 1x`} />": ("img", True, {"srcset": "{`${a > b ? `x${c}` : '}'} 1x`}"}),
    '<script src="https://x.example/a.js" onLoad={() => { f("}") }}>': ("script", True, {"src": "https://x.example/a.js", "onload": '{() => { f("}") }}'}),
    "<Image style={{a: {b: 1}}} priority\n  alt='x > y'/>": ("Image", True, {"style": "{{a: {b: 1}}}", "priority": "", "alt": "x > y"}),
    "<a href=/x/y.html class=b>": ("a", True, {"href": "/x/y.html", "class": "b"}),
    "<div {...rest} id='k'>": ("div", True, {"id": "k"}),
    "<p <?php if ($a > 1) echo 'x'; ?> class=\"c\">": ("p", True, {"class": "c"}),
    '<td data-v="never closed': ("td", False, {}),
    "<b onClick={() => { if (a) {": ("b", False, {}),
    "<i x": ("i", False, {"x": ""}),
}


@pytest.mark.parametrize("text", MARKUP)
def test_markup_scanner(text):
    name, closed, attributes = MARKUP[text]
    got = markup.read_tags("text < 1\n" + text)
    first = next(t for t in got if t["name"] == name)
    have = {a["name"]: a["value"] for a in first["attributes"] if a["name"] in attributes or closed}
    assert (first["closed"], first["line"], have) == (closed, 2, attributes)


def test_markup_in_comments_and_attributes():
    got = markup.read_tags("<!-- <h1 a='-->'>x</h1> --><H1>\n<Card icon={<img src='a.png'/>} on /><!-- open <p>")
    assert [(t["name"], t["hidden"], t["line"]) for t in got] == [("h1", True, 1), ("H1", False, 1), ("Card", False, 2), ("img", False, 2), ("p", False, 2)]
    assert [a["name"] for a in got[2]["attributes"]] == ["icon", "on"] and not got[0]["closed"]
    assert markup.read_tags(None) == markup.read_postings("") == []


def test_places_of_selectors(spark):
    files = [
        ("c", 1, "a.tsx", "<div\n className='x\n  ad-banner-2 ad--top _b'>\n<i id=\"ad\">"), ("c", 1, "b.tsx", 'echo "<p class=\'hero ad-banner\'>"; data-id="late"'), ("d", 1, "a.tsx", "<p class='hero'>"), ("c", 2, "z.tsx", "<p class='only-here'>"),
    ]
    frame = spark.createDataFrame(files, "client string, run_id int, rel_path string, content string")
    asked = [
        ("c", 1, ".ad", "a.tsx", 2), ("c", 1, ".ad-banner", "a.tsx", 2), ("c", 1, ".ad-banner-2", "a.tsx", 2), ("c", 1, ".banner-2", "a.tsx", 2), ("c", 1, ".ad--top", "a.tsx", 2), ("c", 1, ".ad-top", None, None), ("c", 1, ".b", None, None),
        ("c", 1, ".hero", "b.tsx", 1), ("c", 1, "p#late", "b.tsx", 1), ("c", 1, ".only-here", None, None), ("d", 1, ".hero", "a.tsx", 1), ("c", 2, ".only-here", "z.tsx", 1), ("c", 1, ".banner-ad", None, None), ("c", 1, ".x-ad", None, None),
    ]
    made = spark.createDataFrame([a[:3] for a in asked], "client string, run_id int, culprit_selector string")
    got = {(r.client, r.run_id, r.culprit_selector): (r.code_file, r.code_line) for r in codeaudit.link_findings(made, frame).collect()}
    assert got == {a[:3]: a[3:] for a in asked}


def test_source_findings_have_lines(spark):
    files = [("p", "index.php", "<html>\n<head>\n<base href='/'>\n<meta name='robots' content='a'><meta name='googlebot'>\n<meta name='robots'>\n<!--\n<h1>old</h1> -->"), ("p", ".htaccess", ""), ("n", "app/layout.tsx", "// x\n'use client'\n<script>1</script>")]
    frame = spark.createDataFrame([(c, 1, p, t) for c, p, t in files], "client string, run_id int, rel_path string, content string")
    stacks = spark.createDataFrame([("p", 1, ["php-custom"]), ("n", 1, ["nextjs"])], "client string, run_id int, stacks array<string>")
    found = codeaudit.file_findings(frame, stacks)
    lines = {r.rule: r.code_line for r in found.collect() if r.code_line}
    assert lines == {"base_href": 3, "robots_meta_conflict": 4, "h1_only_in_comment": 7, "use_client_layout": 2, "raw_script": 3}
    by = {(r.client, r.code_file): [(x.rule, x.line) for x in r.listing] for r in codeaudit.by_file(found).collect()}
    assert by["n", "app/layout.tsx"] == [("use_client_layout", 2), ("raw_script", 3)] and by["p", "index.php"][0] == ("h1_only_in_comment", 7)


def test_places_in_groups_of_any_size(spark):
    rows = [("a", i % 7, i) for i in range(500)] + [("b", 1, i) for i in range(3)] + [(None, 0, 1), (None, 5, 2)]
    frame = spark.createDataFrame(rows, "g string, score int, seq int").repartition(5)
    got = sorted((r.g or "", r.place, r.score, r.seq) for r in ranking.place_all(frame, ["g"], [F.desc("score"), F.asc("seq")]).collect())
    want = []
    for g in ("", "a", "b"):
        own = sorted(((s, q) for x, s, q in rows if (x or "") == g), key=lambda x: (-x[0], x[1]))
        want += [(g, i + 1, s, q) for i, (s, q) in enumerate(own)]
    assert got == want
    assert ranking.place_all(frame.where("seq < 0"), ["g"], ["seq"]).count() == 0


def test_plans_of_ranks(spark):
    """No window over a run: full ranks have one over ranges, limits keep n rows of each run in every task."""
    frame = spark.createDataFrame([("c", 1, "onpage", "low", "t", "u", 0.1, 1, "r", "e", 1)], "client string, run_id int, category string, severity string, title string, url string, phase_share double, seq int, rule string, evidence string, impact int")
    full = findings.sort_findings(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in full and "_range" in full
    capped = findings.cap_findings(frame, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in capped and "Partial" in capped


def test_source_tree(spark, tmp_path):
    for rel in ("a.php", ".htaccess", ".json", "x.PHP", "n.md", "s/b.tsx", "s/t/c.css", "s/t/.htaccess", "vendor/v.php", "s/node_modules/deep/m.js", "s/.git/g.json", "vendors/w.js"):
        (tmp_path / "c" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / rel).write_text("x\n")
    (tmp_path / "c" / "big.js").write_bytes(b"y" * 301)
    (tmp_path / "c" / "bad.js").write_bytes(b"\xff\n\n")
    (tmp_path / "c" / "loop").symlink_to(tmp_path / "c")
    (tmp_path / "c" / "link.js").symlink_to(tmp_path / "c" / "big.js")
    (tmp_path / "none").mkdir()
    listed = codeaudit.scan(spark, {"c": str(tmp_path / "c"), "uri": f"file://{tmp_path}/c/s", "none": str(tmp_path / "none")}, 7)
    got = {(r.client, r.run_id, r.rel_path) for r in listed.collect()}
    assert got == {("c", 7, p) for p in ("a.php", ".htaccess", "x.PHP", "s/b.tsx", "s/t/c.css", "s/t/.htaccess", "vendors/w.js", "big.js", "bad.js")} | {("uri", 7, p) for p in ("b.tsx", "t/c.css", "t/.htaccess")}
    files = {(r.client, r.rel_path): r for r in codeaudit.read_files(listed, max_bytes=300, max_files=5).collect()}
    assert sorted(p for c, p in files if c == "c") == [".htaccess", "a.php", "bad.js", "s/b.tsx", "s/t/.htaccess"]
    assert files["c", "bad.js"].content == "\ufffd\n\n" and files["c", "bad.js"].line_count == 3
    assert {r.client: (r.files, r.oversized, r.truncated) for r in codeaudit.scan_counters(listed, 300, 5).collect()} == {"c": (5, 1, True), "uri": (3, 0, False)}
    with pytest.raises(Exception, match="(?i)not.?found|no such file|does not exist"):
        codeaudit.scan(spark, {"c": str(tmp_path / "absent")}).count()


def test_contents_are_read_in_small_batches(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for i in range(40):
        (tmp_path / "c" / f"f{i:02}.js").write_text(str(i) * (i + 1))
    listed = codeaudit.scan(spark, {"c": str(tmp_path / "c")})
    assert {r.rel_path: r.content for r in source_tree.contents(listed, part_bytes=500, batch_bytes=30).collect()} == {f"f{i:02}.js": str(i) * (i + 1) for i in range(40)}
    assert source_tree.contents(listed.where("false")).count() == 0


def test_mentions_by_client(spark):
    answers = spark.createDataFrame([
        ("a", 1, 1, "We like Acme-Works and Rival!", "own"), ("a", 1, 2, None, None), ("b", 1, 3, "acmeworks, RİVAL", "x"), ("c", 1, 4, "acmeworks rival", "y"), ("a", 1, 1, "We like Acme-Works and Rival!", "own"), (None, 1, 5, "rival", "z"),
    ], "client string, run_id int, n int, text string, answer_excerpt string")
    brands = spark.createDataFrame([("a", "Acme Works"), ("a", "!!"), ("a", None), ("b", "other"), (None, "rival")], "client string, token string")
    rivals = spark.createDataFrame([("a", "rival.com"), ("a", "rival.de"), ("a", "rival.com"), ("a", "we.com"), ("b", "acmeworks.com"), ("b", "rival.com"), ("b", None)], "client string, domain string")
    out = ai.detect_mentions(answers, brands, rivals)
    assert sorted(out.columns) == ["answer_excerpt", "client", "client_mentioned", "competitors_mentioned", "n", "run_id", "text"]
    got = sorted((r.n, r.client_mentioned, r.competitors_mentioned, r.answer_excerpt) for r in out.collect() if r.n != 2)
    assert got == [
        (1, True, ["rival.com", "rival.de"], "We like Acme-Works and Rival!"), (1, True, ["rival.com", "rival.de"], "We like Acme-Works and Rival!"),
        (3, False, ["acmeworks.com", "rival.com"], "acmeworks, RİVAL"), (4, False, [], "acmeworks rival"), (5, False, [], "rival"),
    ]
    assert [(r.client_mentioned, r.competitors_mentioned, r.answer_excerpt) for r in out.where("n = 2").collect()] == [(False, [], None)]
    assert ai.detect_mentions(answers, brands.where("false"), rivals.where("false")).where("client_mentioned or size(competitors_mentioned) > 0").count() == 0


def test_configurations_are_parsed_once(spark):
    """Neither result parses the payloads again, however many fields are read from them."""
    rows = [(1, '{"domain":"a.com","brandName":"B","brandTokens":["a"],"seedKeywords":["x"]}'), (2, '{"domain":""}')]
    good, bad = configs.read(spark.createDataFrame(rows, "id int, payload string"))
    for part in (good, bad):
        assert "parse_json" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in good.collect()] == [1] and [r.errors for r in bad.collect()] == [["domain", "brandName", "brandTokens", "seedKeywords"]]


def test_a_tree_of_many_folders_is_listed_in_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / "c" / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / "c" / f"d{i}" / "e" / "a.php").write_text("x")
    listed = codeaudit.scan(spark, {"c": str(tmp_path / "c")})
    assert listed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.rel_path for r in listed.collect()) == sorted(f"d{i}/e/a.php" for i in range(300))


def test_one_widespread_rule_is_spread_over_parts(spark):
    """Findings of one rule meet the rule's size in several parts, and collapse as before."""
    rows = [("c", 1, "onpage", "low", "t", f"u{i:03}", 0.1, 1, "r", "e", i) for i in range(200)]
    frame = spark.createDataFrame(rows, "client string, run_id int, category string, severity string, title string, url string, phase_share double, impact int, rule string, evidence string, seq int")
    out = findings.collapse_widespread(frame)
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.evidence for r in out.collect()] == ["200 pages: u000, u001, u002, u003, u004 (+195)"]
