"""Tables that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .competitors import REPORT_LIMIT
from .keys import KEYS, top


def competitor_map(competitors: DataFrame, n: int = REPORT_LIMIT) -> DataFrame:
    """Real competitors and those among the first ``n`` by rate, ``n`` of them at most."""
    order = [F.desc("appearance_rate"), F.asc("domain")]
    placed = top(competitors, 2**31 - 1, [*KEYS], order, "at")
    return top(placed.where(F.col("is_real_competitor") | (F.col("at") <= n)), n, [*KEYS], order).drop("at")


MAX_ACTIONS, TOP = 12, {"opportunity": 5, "vitals": 2, "onpage": 5, "crawl": 5, "code": 5, "gap": 3}


def _branch(df: DataFrame, nr: int, kind: str, n: int, priority: Column | int, text: Column, order: list[Column]) -> DataFrame:
    """The first ``n`` actions of one branch, by priority and then the branch's own order."""
    level = F.lit(priority) if isinstance(priority, int) else priority
    first = top(df.withColumns({"priority": level.cast("int"), "kind": F.lit(kind), "text": text.cast("string"), "branch": F.lit(nr)}), n, [*KEYS], [F.asc("priority"), *order], "at")
    return first.select(*KEYS, "priority", "branch", "kind", "text", "at")


def action_candidates(alerts: DataFrame, opportunities: DataFrame, vitals: DataFrame, onpage: DataFrame, indexing: DataFrame, crawl: DataFrame, code: DataFrame, gaps_in_answers: DataFrame, keyword_gaps: DataFrame, n: int = MAX_ACTIONS) -> DataFrame:
    """priority, branch, kind, text, at: the first ``n`` actions of each of a run's nine branches.

    alerts: severity, subject. opportunities: keyword, score, volume. Findings: rule, severity, url, phase_share, seq.
    gaps_in_answers: query. keyword_gaps: keyword, volume. Synthetic findings are to be left out before. Every place is asked
    for up to a limit, so tasks keep that many rows of a run before anything is shuffled.
    """
    from .findings import collapse_widespread, findings_order

    grave = F.when(F.col("severity") == "critical", 1).otherwise(2)
    named = F.concat_ws(" ", "rule", "url")
    best = lambda df, kind, by, order: top(df, TOP[kind], by, order, "nth")
    nth, keys = [F.asc("nth")], [*KEYS]
    branches = [
        _branch(alerts, 0, "trend", n, F.when(F.col("severity") == "warning", 1).otherwise(3), F.col("subject"), [F.asc("subject")]),
        _branch(best(opportunities, "opportunity", keys, [F.desc("score"), F.desc("volume"), F.asc("keyword")]), 1, "opportunity", n, 2, F.col("keyword"), nth),
        _branch(best(vitals, "vitals", [*KEYS, "url"], findings_order()), 2, "technical", n, grave, named, [F.asc("url"), F.asc("nth")]),
        _branch(best(onpage, "onpage", keys, findings_order()), 3, "on-page", n, grave, named, nth),
        _branch(indexing, 4, "indexing", n, 1, named, [F.asc("seq")]),
        _branch(best(collapse_widespread(crawl), "crawl", keys, findings_order()), 5, "crawl", n, grave, named, nth),
        _branch(best(code, "code", keys, findings_order()), 6, "code", n, grave, named, nth),
        _branch(gaps_in_answers, 7, "ai-visibility", n, 2, F.col("query"), [F.asc("query")]),
        _branch(best(keyword_gaps, "gap", keys, [F.coalesce("volume", F.lit(-1)).desc(), F.asc("keyword")]), 8, "keyword-gap", n, 3, F.col("keyword"), nth),
    ]
    every = branches[0]
    for b in branches[1:]:
        every = every.unionByName(b)
    return every


def prioritized_actions(candidates: DataFrame, n: int = MAX_ACTIONS) -> DataFrame:
    """The first ``n`` actions of each run: by priority, then branch, then the branch's own order."""
    return top(candidates, n, [*KEYS], [F.asc("priority"), F.asc("branch"), F.asc("at")]).drop("at")


def headline(keywords: DataFrame, competitors: DataFrame, answers: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per run of counts: keywords, real competitors, gaps in answers, rank changes."""
    count = lambda df, name: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
    out = count(keywords, "keywords")
    for part in (count(competitors.where("is_real_competitor"), "real_competitors"), count(answers.where("is_gap"), "ai_gaps"), count(changes, "rank_changes")):
        out = out.join(part, [*KEYS], "left")
    return out.na.fill(0)


def tech_evaluation(audits: DataFrame) -> DataFrame:
    """Audits with pass marks of each vital and whether the page is the client's own."""
    from ..functions.text import root_domain
    from .vitals import LIMITS

    return audits.select(*KEYS, "url", (root_domain(F.col("url")) == F.col("client")).alias("is_client"), (F.col("lcp_ms") <= LIMITS["LCP"][0]).alias("passes_lcp"), (F.col("inp_ms") <= LIMITS["INP"][0]).alias("passes_inp"), (F.col("cls") <= LIMITS["CLS"][0]).alias("passes_cls"))


def distinct_client_issues(issues: DataFrame) -> DataFrame:
    """Issues of the client's own audited pages, each once however many pages repeat it. issues: client, run_id, url, kind, subject."""
    from ..functions.urls import same_site

    return issues.where(same_site(F.col("url"), F.col("client"))).select(*KEYS, "kind", "subject").distinct()


def field_cwv_comparison(field: DataFrame) -> DataFrame:
    """Field vitals, the client's own pages first."""
    from ..functions.text import root_domain

    own = root_domain(F.col("url")) == F.col("client")
    return top(field.withColumn("is_client", own), 2**31 - 1, [*KEYS], [F.desc("is_client"), F.asc("url")])


def write_search_rows(rows: DataFrame, path: str) -> None:
    """All search rows as CSV with fixed decimals."""
    out = rows.select("client", "run_id", "query", "page", "clicks", "impressions", F.format_string("%.4f", "ctr").alias("ctr"), F.format_string("%.2f", "avg_position").alias("avg_position"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
