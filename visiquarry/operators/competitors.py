"""Competitor discovery from result pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import KEYS, top

THRESHOLD = 0.15
REPORT_LIMIT = 20

# Domains that are no businesses of the searcher's kind, in order of precedence.
EXCLUDED = {
    "marketplace": ("trendyol.com", "hepsiburada.com", "n11.com", "amazon.com", "amazon.com.tr", "sahibinden.com", "ciceksepeti.com", "armut.com", "bionluk.com", "fiverr.com", "upwork.com"),
    "news": ("hurriyet.com.tr", "milliyet.com.tr", "sozcu.com.tr", "sabah.com.tr"),
    "aggregator": ("onedio.com", "eksisozluk.com", "wikipedia.org", "wikihow.com", "akakce.com", "cimri.com", "epey.com", "foursquare.com", "canva.com", "turbologo.com", "renderforest.com"),
    "social": ("youtube.com", "instagram.com", "facebook.com", "x.com", "linkedin.com", "pinterest.com", "behance.net", "dribbble.com"),
}


def classify_domain(domain: Column) -> Column:
    """Kind of a domain or of one it is below; ``business`` for all others. No domain fits two kinds."""
    out = F.lit("business")
    for kind, names in EXCLUDED.items():
        alternatives = "|".join(n.replace(".", r"\.") for n in names)
        out = F.when(domain.rlike(rf"(^|\.)({alternatives})$"), kind).otherwise(out)
    return out


def discover(serps: DataFrame, clients: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """client, run_id, domain, appearance_rate, classification, is_real_competitor, source.

    serps: client, run_id, serp_id, domain. clients: client, seeds (array). The rate is the share of a run's result pages that
    show the domain; the client's own is left out. Seeds that no page shows have rate 0. Counts are per (run, domain), so a
    client with very many pages is spread over its domains.
    """
    shown = serps.select(*KEYS, "serp_id", "domain").distinct()
    pages = shown.select(*KEYS, "serp_id").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pages"))
    counts = shown.where("domain <> client").groupBy(*KEYS, "domain").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(pages, [*KEYS]).select(*KEYS, "domain", (F.col("n") / F.greatest("pages", F.lit(1))).alias("appearance_rate"))
    seeds = clients.select("client", F.explode("seeds").alias("domain")).distinct()
    missing = pages.join(seeds, "client").select(*KEYS, "domain").join(found, [*KEYS, "domain"], "left_anti").withColumn("appearance_rate", F.lit(0.0))
    every = found.unionByName(missing).join(seeds.withColumn("seed", F.lit(True)), ["client", "domain"], "left")
    kind = classify_domain(F.col("domain"))
    is_seed = F.coalesce("seed", F.lit(False))
    return every.select(
        *KEYS, "domain", "appearance_rate", kind.alias("classification"),
        (is_seed | ((F.col("appearance_rate") >= threshold) & (kind == "business"))).alias("is_real_competitor"),
        F.when(is_seed, "seed").otherwise("discovered").alias("source"),
    )


BACKLINK_LIMIT = 5


def backlink_domains(competitors: DataFrame, clients: DataFrame, n: int = BACKLINK_LIMIT) -> DataFrame:
    """client, run_id, domain, place: the domains whose links are looked up: the client's own, its seeds, and the first ``n`` real
    competitors by rate (equal ones by name); each once, at its first place."""
    runs = competitors.select(*KEYS).distinct()
    own = runs.select(*KEYS, F.col("client").alias("domain"), F.lit(0).alias("place"))
    seeds = runs.join(clients, "client").select(*KEYS, F.posexplode("seeds").alias("at", "domain")).select(*KEYS, "domain", (F.col("at") + 1).alias("place"))
    first = top(competitors.where("is_real_competitor"), n, [*KEYS], [F.desc("appearance_rate"), F.asc("domain")], "at")
    found = first.select(*KEYS, "domain", (F.lit(1_000_000) + F.col("at")).alias("place"))
    return own.unionByName(seeds).unionByName(found).groupBy(*KEYS, "domain").agg(F.min("place").alias("place"))


def real(competitors: DataFrame) -> DataFrame:
    return competitors.where("is_real_competitor").select(*KEYS, "domain")
