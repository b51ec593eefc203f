"""Findings: their shape, impact, rule ids, collapsing over pages, ordering and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import KEYS, top
from .ranking import place_all

SEVERITIES = ("critical", "high", "medium", "low")
IMPACT = {"critical": 70, "high": 45, "medium": 25, "low": 10}
WIDESPREAD, PREVIEW = 3, 5
SALT = 16
BLOCK = 1024


def estimate_impact(severity: Column, share: Column | None = None) -> Column:
    """Points of the severity and up to 30 for the share of a phase, 100 at most."""
    base = F.lit(0)
    for name, points in IMPACT.items():
        base = F.when(severity == name, points).otherwise(base)
    more = F.lit(0) if share is None else F.coalesce(F.floor(share * 30 + 0.5), F.lit(0))
    return F.least(F.lit(100), base + more).cast("int")


def rendered_title(rule: str, detail: Column | None = None) -> Column:
    """The title that a reader sees: the rule in words and, in brackets, what differs from case to case (a count, a status, a keyword)."""
    words = F.lit(rule.replace("_", " "))
    return words if detail is None else F.concat(words, F.lit(" ("), F.coalesce(detail.cast("string"), F.lit("")), F.lit(")"))


def finding(rule: str, category: str, severity: str | Column, url: Column, evidence: Column, share: Column | None = None, detail: Column | None = None) -> Column:
    """A finding as a struct: rule, category, severity, url, title, evidence, impact, phase_share."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    share_ = F.lit(None).cast("double") if share is None else share.cast("double")
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(category).alias("category"), level.alias("severity"), url.cast("string").alias("url"),
        rendered_title(rule, detail).alias("title"), F.coalesce(evidence.cast("string"), F.lit("")).alias("evidence"),
        estimate_impact(level, share_).alias("impact"), share_.alias("phase_share"),
    )


def rule_id(category: Column, title: Column) -> Column:
    """Category and title with its numbers folded, so that one rule's findings share an id."""
    return F.concat_ws("|", category, F.regexp_replace(title, r"\d+([.,]\d+)?", "N"))


def finding_key(category: Column, title: Column, url: Column) -> Column:
    return F.concat_ws("|", rule_id(category, title), F.coalesce(url, F.lit("")))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


FIELDS = ("rule", "category", "severity", "url", "title", "evidence", "impact", "phase_share")


def all_findings(*families: DataFrame) -> DataFrame:
    """Families of findings as one table, repeated rows kept; ``seq`` is their order: family, page (a family's own ``seq``, where
    it has one), rule, URL, evidence."""
    out = None
    for nr, rows in enumerate(families):
        page = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(None).cast("long")
        seq = F.struct(F.lit(nr).alias("family"), F.coalesce(page, F.lit(-1)).alias("page"), "rule", F.coalesce("url", F.lit("")).alias("of"), F.col("evidence").alias("by"))
        rows = rows.select(*KEYS, *FIELDS, seq.alias("seq"))
        out = rows if out is None else out.unionByName(rows)
    return out


def collapse_widespread(findings: DataFrame, seq: str = "seq", over: int = WIDESPREAD, preview: int = PREVIEW) -> DataFrame:
    """A rule that more than ``over`` pages break becomes one finding without URL that names the first pages and counts the rest.

    Groups with a finding that has no URL stay as they are. The first ``preview`` findings of a group are kept by numbering,
    so no group is gathered; a group meets its size in ``SALT`` parts, as one rule may have most of a run's findings.
    """
    rows = findings.withColumn("rule_id", rule_id(F.col("category"), F.col("title")))
    sizes = rows.groupBy(*KEYS, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("urls"), (F.min("title") != F.max("title")).alias("titles_differ"))
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALT)).cast("int")).join(sizes, [*KEYS, "rule_id", "_salt"]).drop("_salt")
    wide = (F.col("n") == F.col("urls")) & (F.col("urls") > over)
    kept = rows.where(~wide).drop("rule_id", "n", "urls", "titles_differ")
    numbered = rows.where(wide).withColumn("place", F.row_number().over(Window.partitionBy(*KEYS, "rule_id").orderBy(seq))).where(F.col("place") <= preview)
    one = F.min_by(F.struct(*(c for c in findings.columns if c not in (*KEYS, "url", "evidence"))), "place")
    groups = numbered.groupBy(*KEYS, "rule_id", "urls", "titles_differ").agg(one.alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]), ", ").alias("shown"))
    more = F.when(F.col("urls") > preview, F.concat(F.lit(" (+"), (F.col("urls") - preview).cast("string"), F.lit(")"))).otherwise("")
    evidence = F.concat(F.col("urls").cast("string"), F.lit(" pages"), F.when(F.col("titles_differ"), " (numbers differ)").otherwise(""), F.lit(": "), F.col("shown"), more)
    collapsed = groups.select(*KEYS, "first.*", F.lit(None).cast("string").alias("url"), evidence.alias("evidence"))
    return kept.unionByName(collapsed)


def findings_order(seq: str = "seq") -> list[Column]:
    """By severity, then share, then as they came."""
    return [severity_rank(F.col("severity")).asc(), F.coalesce("phase_share", F.lit(0.0)).desc(), F.col(seq).asc()]


def sort_findings(findings: DataFrame, seq: str = "seq") -> DataFrame:
    """``place`` within the run, for runs of any size."""
    return place_all(findings, [*KEYS], findings_order(seq))


def cap_findings(findings: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` findings of each run after collapsing, and how many are hidden."""
    rows = collapse_widespread(findings, seq)
    total = rows.groupBy(*KEYS).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("hidden"))
    return top(rows, n, [*KEYS], findings_order(seq)).join(total, [*KEYS])


def mark_synthetic(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """is_mock: the run took the finding's source category from synthetic data."""
    mocks = runs.select("client", "run_id", "mock_categories")
    return findings.join(mocks, [*KEYS], "left").withColumn("is_mock", F.coalesce(F.array_contains("mock_categories", F.col("category")), F.lit(False))).drop("mock_categories")


def url_totals(findings: DataFrame) -> DataFrame:
    """client, run_id, url (null: of no single page), n_findings, impact, worst: a row for each URL."""
    return findings.groupBy(*KEYS, "url").agg(F.count(F.lit(1)).alias("n_findings"), F.max("impact").alias("impact"), F.min(severity_rank(F.col("severity"))).alias("worst"))


def by_url(findings: DataFrame, seq: str = "seq") -> DataFrame:
    """Every finding under its URL: the finding with ``place`` within the URL, gravest first, and ``own_impact``, beside the ``url_totals``.

    A row for each finding, so that no URL's findings are gathered: content gaps have no URL, and a run may have one for most of its
    keywords. A URL's findings meet its totals in blocks of ``BLOCK`` places.
    """
    placed = place_all(findings, [*KEYS, "url"], [*findings_order(seq), F.asc("title")])
    rows = placed.withColumnRenamed("impact", "own_impact").withColumn("_block", F.expr(f"(place - 1) div {BLOCK}"))
    totals = url_totals(findings).withColumn("_of", F.explode(F.expr(f"sequence(0, (n_findings - 1) div {BLOCK})")))
    totals = totals.withColumnsRenamed({c: f"_{c}" for c in (*KEYS, "url")})
    same = F.col("_block") == F.col("_of")
    for c in (*KEYS, "url"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(totals, same).drop("_block", "_of", *(f"_{c}" for c in (*KEYS, "url")))
