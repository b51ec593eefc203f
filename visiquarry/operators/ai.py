"""Mentions in answers of language models, their rates and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mention_key
from .keys import KEYS

WEAK, STRONG = 0.34, 0.5
EXCERPT = 300
SALT = 16


def name_lists(brands: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row per client: brand_keys, and rivals (domain, key) in order of domain, from each client's own lists.

    brands: client, token. competitors: client, domain. A competitor goes by its first label, of three characters or more. Names are
    brought to their keys here, once, not for every answer; a name without letters or digits, or null, is none.
    """
    label = F.split_part(F.col("domain"), F.lit("."), F.lit(1))
    own = brands.select("client", mention_key(F.col("token")).alias("key")).where("key <> ''").groupBy("client").agg(F.collect_set("key").alias("brand_keys"))
    rivals = competitors.select("client", "domain", mention_key(label).alias("key")).where((F.length(label) >= 3) & (F.col("key") != ""))
    rivals = rivals.groupBy("client").agg(F.sort_array(F.collect_set(F.struct("domain", "key"))).alias("rivals"))
    return own.join(rivals, "client", "full")


def detect_mentions(answers: DataFrame, brands: DataFrame, competitors: DataFrame, salt: int = SALT) -> DataFrame:
    """answers with client_mentioned, competitors_mentioned and answer_excerpt; a name is mentioned if the answer's key holds its key.

    Names meet answers by client. A client's lists are those of its configuration, some tens of names, so they travel as one row and
    are tried side by side on the answer's key; a client with most of the answers is spread over ``salt`` copies of its row.
    A client without lists, like a null text, mentions nobody. Any columns of the answers stay, the three above are made anew.
    """
    made = ("client_mentioned", "competitors_mentioned", "answer_excerpt")
    names = name_lists(brands, competitors).select(F.col("client").alias("_client"), F.col("brand_keys").alias("_brands"), F.col("rivals").alias("_rivals"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_copy"))
    kept = [c for c in answers.columns if c not in made]
    keyed = answers.select(*kept, F.coalesce(mention_key(F.col("text")), F.lit("")).alias("_key"), F.pmod(F.xxhash64("text"), F.lit(salt)).cast("int").alias("_salt"))
    met = keyed.join(names, (F.col("client") == F.col("_client")) & (F.col("_salt") == F.col("_copy")), "left")
    named = F.transform(F.filter("_rivals", lambda r: F.contains(F.col("_key"), r["key"])), lambda r: r["domain"])
    return met.select(
        *kept, F.coalesce(F.exists("_brands", lambda b: F.contains(F.col("_key"), b)), F.lit(False)).alias("client_mentioned"),
        F.coalesce(named, F.array().cast("array<string>")).alias("competitors_mentioned"), F.substring("text", 1, EXCERPT).alias("answer_excerpt"),
    )


def visibility(samples: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row per query: samples, the client's rate, the strongest rival and its rate, and whether that is a gap."""
    rates = samples.groupBy(*KEYS, "query").agg(F.count(F.lit(1)).alias("sample_count"), F.avg(F.col("client_mentioned").cast("int")).alias("client_rate"))
    named = samples.select(*KEYS, "query", F.explode("competitors_mentioned").alias("domain")).groupBy(*KEYS, "query", "domain").agg(F.count(F.lit(1)).alias("n"))
    shares = named.join(competitors, [*KEYS, "domain"]).join(rates, [*KEYS, "query"]).withColumn("rate", F.col("n") / F.col("sample_count"))
    best = shares.groupBy(*KEYS, "query").agg(F.max("rate").alias("top_rate"), F.min_by("domain", F.struct(-F.col("rate"), F.col("domain"))).alias("top_competitor"))
    out = rates.join(best, [*KEYS, "query"], "left").withColumn("top_rate", F.coalesce("top_rate", F.lit(0.0)))
    return out.withColumn("is_gap", (F.col("client_rate") < WEAK) & (F.col("top_rate") >= STRONG))


def client_rate(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEYS, "query").agg(F.avg(F.col("client_mentioned").cast("int")).alias("client_rate"))


def competitor_rates(samples: DataFrame, competitors: DataFrame) -> DataFrame:
    """Rate of every rival for every query, 0 where it is never named."""
    total = samples.groupBy(*KEYS, "query").agg(F.count(F.lit(1)).alias("n_samples"))
    named = samples.select(*KEYS, "query", F.explode("competitors_mentioned").alias("domain")).groupBy(*KEYS, "query", "domain").agg(F.count(F.lit(1)).alias("n"))
    every = total.join(competitors, [*KEYS]).join(named, [*KEYS, "query", "domain"], "left")
    return every.select(*KEYS, "query", "domain", (F.coalesce("n", F.lit(0)) / F.col("n_samples")).alias("rate"))


