"""Every completed run against the completed run before it: all clients, runs and kinds of change in one table.

No run is joined with another. A row of a fact table takes part in two comparisons, as the present of its own run and as the past
of the next one; it is told to both and the comparison's two sides meet in one aggregate by (client, run, key), which combines
within tasks first. A comparison's number comes with the run's row from the small table of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diff import AI_DROP, LCP_WORSE, RANK_DROP, UNRANKED
from .findings import finding_key

CHANGE = ("client", "run_id", "previous_run", "kind", "subject", "previous_value", "current_value", "delta", "severity")


def comparisons(runs: DataFrame) -> DataFrame:
    """client, run_id, config_hash, previous_run, next_run, previous_hash of every completed run; null where there is no other. runs: client, run_id, status, config_hash."""
    order = Window.partitionBy("client").orderBy("run_id")
    done = runs.where("status = 'completed'")
    return done.select("client", "run_id", "config_hash", F.lag("run_id").over(order).alias("previous_run"), F.lead("run_id").over(order).alias("next_run"), F.lag("config_hash").over(order).alias("previous_hash"))


def sides(facts: DataFrame, compared: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """client, run_id, previous_run, keys, in_previous, in_current (rows on either side), and the values of both sides as old_* and new_*.

    ``values`` are aggregates' inputs: of repeated keys the greatest value counts.
    """
    named = facts.select("client", "run_id", *keys, *(v.alias(n) for n, v in values.items()))
    placed = named.join(F.broadcast(compared.select("client", "run_id", "previous_run", "next_run")), ["client", "run_id"])
    now = F.when(F.col("previous_run").isNotNull(), F.struct(F.col("run_id").alias("at"), F.col("previous_run").alias("before"), F.lit(True).alias("new")))
    past = F.when(F.col("next_run").isNotNull(), F.struct(F.col("next_run").alias("at"), F.col("run_id").alias("before"), F.lit(False).alias("new")))
    told = placed.withColumn("t", F.explode(F.array_compact(F.array(now, past)))).select("client", F.col("t.at").alias("run_id"), F.col("t.before").alias("previous_run"), F.col("t.new").alias("new"), *keys, *values)
    both = [F.max(F.when(F.col("new") == side, F.col(n))).alias(f"{word}_{n}") for n in values for side, word in ((False, "old"), (True, "new"))]
    return told.groupBy("client", "run_id", "previous_run", *keys).agg(F.count_if(~F.col("new")).alias("in_previous"), F.count_if("new").alias("in_current"), *both)


def _change(rows: DataFrame, kind: Column | str, subject: Column, old: Column, new: Column, delta: Column, severity: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(
        "client", "run_id", "previous_run", kind.alias("kind"), subject.cast("string").alias("subject"),
        old.cast("double").alias("previous_value"), new.cast("double").alias("current_value"), delta.cast("double").alias("delta"), severity.cast("string").alias("severity"),
    )


def rank_changes(keywords: DataFrame, compared: DataFrame) -> DataFrame:
    """Keywords whose rank differs; no rank counts as 11. keywords: client, run_id, keyword, client_rank."""
    both = sides(keywords, compared, ["keyword"], {"rank": F.col("client_rank")}).where(~F.col("old_rank").eqNullSafe(F.col("new_rank")))
    old, new = F.col("old_rank"), F.col("new_rank")
    delta = F.coalesce(old, F.lit(UNRANKED)) - F.coalesce(new, F.lit(UNRANKED))
    kind = F.when(new.isNull(), "rank_lost").when(old.isNull(), "rank_gained").when(-delta >= RANK_DROP, "rank_drop").otherwise("rank_change")
    severity = F.when(kind == "rank_gained", "info").when(kind != "rank_change", "warning")
    return _change(both, kind, F.col("keyword"), old, new, delta, severity)


def competitor_changes(competitors: DataFrame, compared: DataFrame) -> DataFrame:
    """Real competitors that came or went. competitors: client, run_id, domain, is_real_competitor."""
    both = sides(competitors.where("is_real_competitor"), compared, ["domain"], {}).where("in_previous = 0 or in_current = 0")
    came, nothing = F.col("in_current") > 0, F.lit(None)
    return _change(both, F.when(came, "competitor_entry").otherwise("competitor_exit"), F.col("domain"), nothing, nothing, nothing, F.when(came, "info"))


def vitals_changes(audits: DataFrame, compared: DataFrame) -> DataFrame:
    """Differences of three vitals of URLs that both runs audited. audits: client, run_id, url, lcp_ms, inp_ms, cls."""
    metrics = {"lcp": "lcp_ms", "inp": "inp_ms", "cls": "cls"}
    both = sides(audits, compared, ["url"], {m: F.col(c) for m, c in metrics.items()}).where("in_previous > 0 and in_current > 0")
    each = F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"old_{m}").cast("double").alias("old"), F.col(f"new_{m}").cast("double").alias("new")) for m in metrics))
    rows = both.select("client", "run_id", "previous_run", "url", F.explode(each).alias("v")).withColumn("d", F.col("v.new") - F.col("v.old"))
    worse = F.when((F.col("v.m") == "lcp") & (F.col("d") > LCP_WORSE), "warning")
    return _change(rows, F.concat(F.lit("vitals_"), F.col("v.m")), F.col("url"), F.col("v.old"), F.col("v.new"), F.col("d"), worse)


def ai_changes(samples: DataFrame, compared: DataFrame) -> DataFrame:
    """Queries of both runs whose mention rate differs. samples: client, run_id, query, client_mentioned."""
    rates = samples.groupBy("client", "run_id", "query").agg(F.avg(F.col("client_mentioned").cast("int")).alias("rate"))
    both = sides(rates, compared, ["query"], {"rate": F.col("rate")}).where("old_rate <> new_rate")
    fall = F.col("old_rate") - F.col("new_rate")
    return _change(both, "ai_rate", F.col("query"), F.col("old_rate"), F.col("new_rate"), -fall, F.when(fall >= AI_DROP, "warning"))


def page_changes(pages: DataFrame, compared: DataFrame) -> DataFrame:
    """Pages crawled now and before, one row for every comparison. pages: client, run_id, url."""
    counted = pages.groupBy("client", "run_id").agg(F.count(F.lit(1)).alias("n"))
    every = compared.select("client", "run_id").join(counted, ["client", "run_id"], "left").select("client", "run_id", F.coalesce("n", F.lit(0)).alias("n"))
    both = sides(every, compared, [], {"n": F.col("n")})
    return _change(both, "page_count", F.lit(None), F.col("old_n"), F.col("new_n"), F.col("new_n") - F.col("old_n"), F.lit(None))


def config_changes(compared: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    differs = compared.where(F.col("previous_run").isNotNull() & ~F.col("config_hash").eqNullSafe(F.col("previous_hash")))
    return _change(differs, "config_changed", nothing, nothing, nothing, nothing, F.lit("info"))


def finding_changes(findings: DataFrame, compared: DataFrame) -> DataFrame:
    """Keys of findings that only one of the runs has; the value is how many findings have the key. findings: client, run_id, category, title, url."""
    keyed = findings.withColumn("key", finding_key(F.col("category"), F.col("title"), F.col("url")))
    both = sides(keyed, compared, ["key"], {}).where("in_previous = 0 or in_current = 0")
    new = F.col("in_current") > 0
    return _change(both, F.when(new, "finding_new").otherwise("finding_resolved"), F.col("key"), F.col("in_previous"), F.col("in_current"), F.col("in_current") - F.col("in_previous"), F.lit(None))


def changes(runs: DataFrame, keywords: DataFrame, competitors: DataFrame, audits: DataFrame, samples: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """All changes of all comparisons, one row each (columns CHANGE); those with a severity are alerts."""
    compared = comparisons(runs)
    parts = [
        rank_changes(keywords, compared), competitor_changes(competitors, compared), vitals_changes(audits, compared), ai_changes(samples, compared),
        page_changes(pages, compared), config_changes(compared), finding_changes(findings, compared),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts(found: DataFrame) -> DataFrame:
    return found.where("severity is not null")


def summary(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Every completed run: is_baseline (nothing to compare with), config_mismatch, page_count_delta and counts of what changed."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    counted = found.groupBy("client", "run_id").agg(
        count("config_changed").alias("config"), F.sum(F.when(F.col("kind") == "page_count", F.col("delta"))).cast("long").alias("page_count_delta"),
        count("rank_lost", "rank_gained", "rank_drop", "rank_change").alias("rank_changes"), count("competitor_entry").alias("competitor_entries"), count("competitor_exit").alias("competitor_exits"),
        count("vitals_lcp").alias("vitals_deltas"), count("ai_rate").alias("ai_deltas"), count("finding_new").alias("new_findings"), count("finding_resolved").alias("resolved_findings"), F.count("severity").alias("alerts"),
    )
    rows = comparisons(runs).select("client", "run_id", "previous_run").join(counted, ["client", "run_id"], "left")
    numbers = [c for c in counted.columns if c not in ("client", "run_id", "config")]
    return rows.select("client", "run_id", "previous_run", F.col("previous_run").isNull().alias("is_baseline"), (F.coalesce("config", F.lit(0)) > 0).alias("config_mismatch"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))
