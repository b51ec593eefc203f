"""Source-code audit: stacks, rules over landed source files, secrets redacted, findings located in code.

files: client, run_id, rel_path, content. A file is parsed once: its tags with their attributes, inside comments and outside,
the names that it exports and imports, and the parts of its path. Rules about one file are conditions on those columns, in one
array over one scan; rules about a client's files are one grouped aggregate of booleans and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markup, source_tree
from .findings import finding, severity_rank
from .keys import KEYS, top

MAX_FILES, MAX_BYTES = 2000, 300_000

_SECRET = r"""(?i)((?:password|passwd|pwd|secret|api_?key|access_?key|token)\w*["']?\s*(?:=>|[:=])\s*["'])[^"'\r\n]+(["'])"""
REDACTED = "***REDACTED***"


def redact(content: Column) -> Column:
    """Values given to names of secrets replaced."""
    return F.regexp_replace(content, _SECRET, f"$1{REDACTED}$2")


def scan(spark: SparkSession, trees: dict[str, str], run_id: int = 1) -> DataFrame:
    """Readable files below each client's root, as a listing: client, run_id, root, rel_path, length. No file is opened."""
    return source_tree.listing(spark, trees, run_id)


def _kept(rows: DataFrame, max_bytes: int, max_files: int | None) -> DataFrame:
    sized = rows.where(F.col("length") <= max_bytes)
    return sized if max_files is None else top(sized, max_files, [*KEYS], [F.asc("rel_path")], "_nth").drop("_nth")


def source_files(rows: DataFrame, max_bytes: int = MAX_BYTES, max_files: int | None = MAX_FILES) -> DataFrame:
    """Files of a size that is read, ``max_files`` of each run in order of path (a limit of the audit itself; None: all), with line counts."""
    kept = _kept(rows, max_bytes, max_files)
    return kept.select(*KEYS, "rel_path", F.size(F.split("content", "\n")).alias("line_count"), redact(F.col("content")).alias("content"))


def read_files(listed: DataFrame, max_bytes: int = MAX_BYTES, max_files: int | None = MAX_FILES) -> DataFrame:
    """``source_files`` of a scan: only the files that are kept are opened."""
    return source_files(source_tree.contents(_kept(listed, max_bytes, max_files)), max_bytes, None)


def scan_counters(listed: DataFrame, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """files that are read, oversized ones that are not, truncated: whether there are more than are read."""
    fits = F.count_if(F.col("length") <= max_bytes)
    return listed.groupBy(*KEYS).agg(F.least(fits, F.lit(max_files).cast("long")).alias("files"), F.count_if(F.col("length") > max_bytes).alias("oversized"), (fits > max_files).alias("truncated"))


# What names the frameworks' configuration files, locale parameters, cache directives and tags long without use.
CONFIG_KINDS = {"next": ("js", "mjs", "ts", "cjs"), "nuxt": ("js", "mjs", "ts"), "astro": ("js", "mjs", "ts")}
STACK_NAMES = {"next": "nextjs", "nuxt": "nuxt", "astro": "astro"}
LOCALE_PARAMETERS = ("dil", "lang", "locale")
CACHE_DIRECTIVES = ("expiresactive", "cache-control", "mod_expires")
DEAD_METAS = ("distribution", "resource-type", "rating", "audience")
OPEN_GRAPH = ("og:title", "og:description", "og:image")
FONT_HOSTS = ("fonts.googleapis.com", "fonts.gstatic.com")
LEGACY_IMAGES = (".jpg", ".jpeg", ".png")

def _every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _after(text: Column, pattern: str) -> Column:
    """What follows each match of a pattern, up to the next one."""
    parts = F.split(text, pattern)
    return F.slice(parts, 2, F.size(parts))


def parsed(files: DataFrame) -> DataFrame:
    """files with tags, exports, constants, imports, directives, file (parts of its name)."""
    text = F.col("content")
    constants = F.arrays_zip(_every(text, _CONSTANT, 1).alias("name"), _every(text, _CONSTANT, 2).alias("value"))
    return markup.with_tags(files).withColumns({
        "exports": _every(text, r"\bexport\s+(?:async\s+)?(?:const|let|var|function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1),
        "constants": constants,
        "imports": _every(text, r"""\b(?:from|import)\s*["']([^"'\n]+)["']""", 1),
        "directives": _every(text, r"""(?m)^[ \t]*["'](use [a-z]+)["']""", 1),
        "file": F.split(F.substring_index("rel_path", "/", -1), r"\."),
    })


_CONSTANT = r"""\bexport\s+const\s+([A-Za-z_$][A-Za-z0-9_$]*)[^=;\n]*=\s*["']([^"'\n]*)["']"""


def _file(stem: str, kinds: tuple[str, ...], middle: tuple[str, ...] = ()) -> Column:
    """A file of this name: stem, middle parts, and one of the extensions."""
    names = [F.lit(x) for x in (stem, *middle)]
    return F.array_contains(F.array(*(F.concat_ws(".", *names, F.lit(k)) for k in kinds)), F.array_join("file", "."))


def _value(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in lower case; null without the attribute."""
    return F.lower(F.get(F.filter(tag["attributes"], lambda a: a["name"] == name), F.lit(0))["value"])


def _tags(name: str, test=lambda t: F.lit(True)) -> Column:
    """Tags of a name, however it is written, that pass a test; those in comments too, as they are source all the same."""
    return F.filter("tags", lambda t: (F.lower(t["name"]) == name) & F.coalesce(test(t), F.lit(False)))


def _line(tags: Column) -> Column:
    """The line of the first of some tags."""
    return F.get(tags, F.lit(0))["line"]


def _has_attribute(tag: Column, *names: str) -> Column:
    return F.exists(tag["attributes"], lambda a: a["name"].isin(*names))


def detect_stack(files: DataFrame) -> DataFrame:
    """client, run_id, stacks (array): what the names of a client's files give away; several may hold."""
    name = F.substring_index("rel_path", "/", -1)
    seen = files.select(*KEYS, name.alias("name"), F.split(name, r"\.").alias("file")).groupBy(*KEYS).agg(
        *(F.bool_or(F.col("name") == n).alias(k) for k, n in (("wp", "wp-config.php"), ("index", "index.php"), ("ht", ".htaccess"))),
        *(F.bool_or(_file(k, kinds, ("config",))).alias(k) for k, kinds in CONFIG_KINDS.items()),
    )
    php = F.when(F.col("wp"), "wordpress").when(F.col("index") & F.col("ht"), "php-custom")
    return seen.select(*KEYS, F.array_compact(F.array(php, *(F.when(F.col(k), n) for k, n in STACK_NAMES.items()))).alias("stacks"))


def file_rules() -> list[tuple[str, str, str, str | Column, Column, Column]]:
    """(stack, rule, category, severity, condition, evidence) of every rule about one parsed file; stack '' holds everywhere."""
    text, low = F.col("content"), F.lower("content")
    none, some = F.lit(""), lambda c: F.size(c) > 0
    count = lambda c: F.size(c).cast("string")
    uses = lambda module: F.array_contains("imports", module)
    exports = lambda name: F.array_contains("exports", name)
    ends = lambda value, kinds: F.exists(F.array(*map(F.lit, kinds)), lambda k: value.endswith(k))
    modern = lambda t: F.exists(t["attributes"], lambda a: F.lower(a["value"]).contains("webp") | F.lower(a["value"]).contains("avif"))
    images = _tags("img", lambda t: t["closed"] & ends(_value(t, "src"), LEGACY_IMAGES) & ~modern(t))
    eager = F.filter(images, lambda t: F.coalesce(_value(t, "loading") != "lazy", F.lit(True)))
    scripts = _tags("script", lambda t: t["closed"] & (_value(t, "src").startswith("http://") | _value(t, "src").startswith("https://")))
    blocking = F.filter(scripts, lambda t: ~_has_attribute(t, "async", "defer"))
    htaccess = F.substring_index("rel_path", "/", -1) == ".htaccess"
    head = some(_tags("head")) & ~F.lower(F.element_at("file", -1)).isin("html", "htm")
    metas = F.size(_tags("meta", lambda t: _value(t, "name").isin("robots", "googlebot")))
    cards = F.array_distinct(F.transform(_tags("meta", lambda t: _value(t, "property").isin(*OPEN_GRAPH)), lambda t: _value(t, "property")))
    stale = _tags("meta", lambda t: ((_value(t, "http-equiv") == "pragma") & (_value(t, "content") == "no-cache")) | ((_value(t, "http-equiv") == "expires") & (_value(t, "content") == "0")))
    dead = _tags("meta", lambda t: _value(t, "name").isin(*DEAD_METAS))
    data = _tags("script", lambda t: _value(t, "type") == "application/ld+json")
    plain_script = _tags("script", lambda t: F.coalesce(_value(t, "type") != "application/ld+json", F.lit(True)))
    component = F.filter("tags", lambda t: t["name"] == "Image")
    page, layout = _file("page", ("ts", "tsx")), _file("layout", ("ts", "tsx"))
    segment = F.exists(F.split("rel_path", "/"), lambda x: x.startswith("[") & x.endswith("]"))
    after_dynamic = _after(text, r"\bdynamic\s*\(")
    return [
        ("", "legacy_images", "cwv", F.when(some(eager), "medium").otherwise("low"), some(images), F.concat_ws("/", count(eager), count(images))),
        ("", "third_party_scripts", "cwv", F.when(some(blocking), "high").otherwise("medium"), some(scripts), F.concat_ws("/", count(blocking), count(scripts))),
        ("", "no_cache_directive", "cwv", "medium", htaccess & ~F.exists(F.array(*map(F.lit, CACHE_DIRECTIVES)), lambda d: F.contains(low, d)), none),
        ("", "no_https_rule", "indexing", "medium", htaccess & ~low.contains("%{https}"), none),
        ("php", "robots_meta_conflict", "indexing", "medium", head & (metas >= 3), metas.cast("string")),
        ("php", "og_incomplete_source", "onpage", "low", head & F.size(cards).between(1, len(OPEN_GRAPH) - 1), none),
        ("php", "no_cache_pragma", "cwv", "medium", head & some(stale), none),
        ("php", "dead_meta", "onpage", "low", head & (F.size(dead) >= 2), count(dead)),
        ("php", "base_href", "links", "low", head & some(_tags("base", lambda t: _has_attribute(t, "href"))), none),
        ("php", "no_structured_data", "onpage", "low", head & ~some(data), none),
        ("php", "h1_only_in_comment", "onpage", "high", some(_tags("h1")) & F.forall(_tags("h1"), lambda t: t["hidden"]), none),
        ("nextjs", "use_client_layout", "cwv", "high", layout & F.array_contains("directives", "use client"), none),
        ("nextjs", "dynamic_ssr_false", "indexing", "low", F.exists(after_dynamic, lambda x: x.rlike(r"\bssr\s*:\s*false\b")), none),
        ("nextjs", "force_dynamic", "cwv", "medium", F.exists("constants", lambda c: (c["name"] == "dynamic") & (c["value"] == "force-dynamic")), none),
        ("nextjs", "no_generate_static_params", "cwv", "low", page & segment & ~exports("generateStaticParams"), none),
        ("nextjs", "missing_metadata", "onpage", "high", page & ~exports("metadata") & ~exports("generateMetadata"), none),
        ("nextjs", "raw_img", "cwv", "medium", F.exists("tags", lambda t: t["name"] == "img") & ~uses("next/image"), none),
        ("nextjs", "image_without_priority", "cwv", "low", page & some(component) & ~text.rlike(r"\bpriority\b"), none),
        ("nextjs", "raw_script", "cwv", "low", F.exists(plain_script, lambda t: t["name"] == "script") & ~uses("next/script"), none),
    ]


def places() -> dict[str, Column]:
    """The line of a finding about one file, for the rules that name one: where the first of their tags or words stands."""
    text = F.col("content")
    before = lambda pattern: F.when(text.rlike(pattern), F.size(F.split(F.get(F.split(text, pattern, 2), F.lit(0)), "\n")))
    named = lambda attribute, *values: _tags("meta", lambda t: _value(t, attribute).isin(*values))
    return {
        "robots_meta_conflict": F.coalesce(_line(named("name", "robots")), _line(named("name", "googlebot"))),
        "no_cache_pragma": F.coalesce(_line(named("http-equiv", "pragma")), _line(named("http-equiv", "expires"))),
        "dead_meta": _line(named("name", *DEAD_METAS)),
        "base_href": _line(_tags("base", lambda t: _has_attribute(t, "href"))),
        "h1_only_in_comment": _line(_tags("h1")),
        "use_client_layout": before(r"""["']use client["']"""),
        "dynamic_ssr_false": before(r"\bdynamic\s*\("),
        "force_dynamic": before(r"\bexport\s+const\s+dynamic\s*="),
        "raw_img": _line(_tags("img")),
        "raw_script": _line(_tags("script", lambda t: F.coalesce(_value(t, "type") != "application/ld+json", F.lit(True)))),
    }


def _holds(stack: str) -> Column:
    if not stack:
        return F.lit(True)
    names = ("php-custom", "wordpress") if stack == "php" else (stack,)
    return F.arrays_overlap("stacks", F.array(*map(F.lit, names)))


def file_findings(files: DataFrame, stacks: DataFrame) -> DataFrame:
    """Findings about single files; url and code_file are the path, code_line the place where a rule names one."""
    lines = places()
    made = [
        F.when(F.coalesce(_holds(stack) & cond, F.lit(False)), F.struct(finding(rule, category, sev, F.col("rel_path"), evidence).alias("f"), lines.get(rule, F.lit(None)).cast("int").alias("line")))
        for stack, rule, category, sev, cond, evidence in file_rules()
    ]
    rows = parsed(files).join(stacks, [*KEYS], "left").withColumn("stacks", F.coalesce("stacks", F.array().cast("array<string>")))
    found = rows.select(*KEYS, "rel_path", F.explode(F.array_compact(F.array(*made))).alias("x"))
    return found.select(*KEYS, "x.f.*", F.col("rel_path").alias("code_file"), F.col("x.line").alias("code_line"))


def project_findings(files: DataFrame, stacks: DataFrame) -> DataFrame:
    """Findings about a client's files together."""
    text, low = F.col("content"), F.lower("content")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    folders = F.split("rel_path", "/")
    under_app = F.array_contains(F.slice(folders, 1, F.size(folders) - 1), "app")
    in_app = F.coalesce(F.get(folders, F.size(folders) - 2) == "app", F.lit(False))
    parameters = F.transform(_every(text, r"\?\s*([A-Za-z_]+)=\$1", 1), F.lower)
    after_alternates = _after(text, r"\balternates\s*:\s*\{")
    seen = parsed(files).groupBy(*KEYS).agg(
        F.count_if(F.lower(F.element_at("file", -1)).isin("html", "htm") & (F.size("file") > 1)).alias("html"),
        any_((F.substring_index("rel_path", "/", -1) == ".htaccess") & F.arrays_overlap(parameters, F.array(*map(F.lit, LOCALE_PARAMETERS)))).alias("routed"), any_(low.contains("hreflang=")).alias("hreflang"),
        any_(_file("page", ("ts", "tsx"))).alias("pages"), any_(F.exists(after_alternates, lambda x: F.substring_index(x, "}", 1).contains("canonical"))).alias("canonical"),
        any_(under_app).alias("app"), any_(in_app & (_file("robots", ("ts", "tsx")) | _file("sitemap", ("ts", "tsx")))).alias("robots"),
        any_(F.exists(F.array(*map(F.lit, FONT_HOSTS)), lambda h: F.contains(low, h))).alias("fonts"), any_(F.exists("imports", lambda m: m.startswith("next/font"))).alias("next_font"),
    )
    rows = seen.join(stacks, [*KEYS], "left").withColumn("stacks", F.coalesce("stacks", F.array().cast("array<string>")))
    none, url = F.lit(""), F.lit(None).cast("string")
    rules = [
        ("", "public_dead_html", "indexing", F.when(F.col("html") >= 10, "medium").otherwise("low"), F.col("html") > 0, F.col("html").cast("string")),
        ("php", "missing_hreflang_source", "indexing", "medium", F.col("routed") & ~F.col("hreflang"), none),
        ("nextjs", "no_canonical_convention", "indexing", "low", F.col("pages") & ~F.col("canonical"), none),
        ("nextjs", "no_robots_sitemap_file", "indexing", "medium", F.col("app") & ~F.col("robots"), none),
        ("nextjs", "no_next_font", "cwv", "medium", F.col("fonts") & ~F.col("next_font"), none),
    ]
    made = [F.when(_holds(stack) & cond, finding(rule, category, sev, url, evidence)) for stack, rule, category, sev, cond, evidence in rules]
    found = rows.select(*KEYS, F.explode(F.array_compact(F.array(*made))).alias("f"))
    return found.select(*KEYS, "f.*", url.alias("code_file"), F.lit(None).cast("int").alias("code_line"))


def by_file(findings: DataFrame) -> DataFrame:
    """client, run_id, code_file (null: no single file), n_findings, worst, listing: array<struct<rank, rule, line, title>>, gravest first."""
    entry = F.struct(severity_rank(F.col("severity")).alias("rank"), "rule", F.col("code_line").alias("line"), "title")
    return findings.groupBy(*KEYS, "code_file").agg(F.count(F.lit(1)).alias("n_findings"), F.min(severity_rank(F.col("severity"))).alias("worst"), F.array_sort(F.collect_list(entry)).alias("listing"))


def selector_token(selector: Column) -> Column:
    """Class, else id, of the last part of a CSS selector; null for a bare tag."""
    names = _every(F.element_at(F.split(F.trim(selector), r"[\s>]+"), -1), "[.#][A-Za-z0-9_-]+")
    first = lambda sign: F.get(F.filter(names, lambda n: n.startswith(sign)), F.lit(0))
    return F.substr(F.coalesce(first("."), first("#")), F.lit(2))


_TOKEN = r"(-*)([A-Za-z0-9_]+)"


def token_places(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """client, run_id, token, code_file, code_line: where class and id attributes hold each token first, by path and offset.

    A token is a phrase of parts between hyphens. Its parts meet the positional index of the files; a place counts if all of them
    stand there in order with the token's own hyphens between them. The index has a row for each part, however tokens combine them.
    """
    asked = tokens.select(*KEYS, "token").distinct()
    spans = F.arrays_zip(_every(F.col("token"), _TOKEN, 1).alias("lead"), _every(F.col("token"), _TOKEN, 2).alias("part"))
    # a part's offset within the token: what stands before it and its own hyphens
    ahead = F.transform(spans, lambda x, i: F.aggregate(F.slice(spans, 1, i), F.length(x["lead"]), lambda n, y: n + F.length(y["lead"]) + F.length(y["part"])))
    parts = asked.select(*KEYS, "token", F.size(spans).alias("n"), F.posexplode(F.arrays_zip(spans.alias("s"), ahead.alias("ahead"))).alias("i", "x"))
    parts = parts.select(*KEYS, "token", "n", "i", "x.s.lead", "x.s.part", "x.ahead")
    index = markup.postings(files).withColumnRenamed("lead", "found_lead")
    met = parts.join(index, [*KEYS, "part"]).where(((F.col("i") == 0) & (F.col("lead") == "")) | F.col("found_lead").eqNullSafe(F.col("lead")))
    whole = met.groupBy(*KEYS, "token", "n", "rel_path", (F.col("offset") - F.col("ahead")).alias("at")).agg(F.count(F.lit(1)).alias("have"), F.min("line").alias("line")).where("have = n")
    first = whole.groupBy(*KEYS, "token").agg(F.min(F.struct("rel_path", "at", "line")).alias("p"))
    return first.select(*KEYS, "token", F.col("p.rel_path").alias("found_file"), F.col("p.line").alias("found_line"))


def link_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings (with culprit_selector) and code_file, code_line: the first file whose attributes hold the selector's token, and
    the line where that attribute starts.

    A finding that has a code_file already keeps its place.
    """
    asked = findings.withColumn("token", selector_token(F.col("culprit_selector")))
    out = asked.join(token_places(asked.where("token is not null"), files), [*KEYS, "token"], "left")
    if "code_file" not in findings.columns:
        return out.drop("token").withColumnsRenamed({"found_file": "code_file", "found_line": "code_line"})
    place = F.when(F.col("code_file").isNull(), F.struct("found_file", "found_line")).otherwise(F.struct(F.col("code_file").alias("found_file"), F.col("code_line").alias("found_line")))
    return out.withColumns({"code_file": place["found_file"], "code_line": place["found_line"]}).select(findings.columns)
