"""Click depth and crawl waves over stored link edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import root_domain
from ..functions.urls import excluded_path, same_site
from ..sources.ingest import robots_allowed
from ..sources.shared import stored
from .keys import KEYS, top

MAX_DEPTH, PAGE_BUDGET = 5, 300


def click_depth(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, budget: int | None = None) -> DataFrame:
    """client, run_id, node, depth: fewest clicks from the seeds, waves up to ``max_depth``.

    edges: source, target. With ``budget`` each wave takes only as many nodes as the run has left, in order of the nodes.
    The loop has at most ``max_depth`` rounds; a round joins its frontier with the edges and leaves out what was reached. Edges
    and waves are written to the shared folder, so a round plans and reads nothing but the written waves before it.
    """
    spread = stored(edges.select(*KEYS, "source", "target").distinct(), "edges")
    frontier = seeds.select(*KEYS, F.col("node")).distinct()
    frontier = frontier if budget is None else top(frontier, budget, [*KEYS], [F.asc("node")]).drop("place")
    reached = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        new = frontier.withColumnRenamed("node", "source").join(spread, [*KEYS, "source"]).select(*KEYS, F.col("target").alias("node")).distinct()
        new = new.join(reached, [*KEYS, "node"], "left_anti")
        if budget is not None:
            used = reached.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("used"))
            new = top(new, budget, [*KEYS], [F.asc("node")]).join(used, [*KEYS]).where(F.col("place") + F.col("used") <= budget).drop("place", "used")
        frontier = stored(new, "wave")
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return reached


def crawl_waves(edges: DataFrame, seeds: DataFrame, sites: DataFrame, rules: DataFrame, max_depth: int = MAX_DEPTH, budget: int = PAGE_BUDGET, agent: str = "*") -> DataFrame:
    """client, run_id, url, depth, place: the pages that a crawl within its limits fetches, in the order of their discovery.

    edges: source, target (URLs), position of the link in its page. seeds: url, position. sites: client, domain, excluded
    (array of paths). rules: host, agent, allow, path, as ``ingest.robots_rules`` gives them. A wave takes the addresses that
    the one before links to and that were not fetched, lie on the client's site, below no excluded path, and are allowed by
    robots rules; they are numbered by the place of the first page that links to them and the link's position there, and
    cut where the run's budget ends; a run without budget left takes no part in later waves.

    A null address, or one of a client without a site, is not fetched; repeated edges and seeds count once; empty tables give
    no rows. A wave is limited before its shuffle to ``budget`` rows of a run in each task.
    """
    links = edges.select(*KEYS, "source", "target", "position")
    seen = None
    wave = seeds.select(*KEYS, "url", F.lit(0).cast("long").alias("page"), F.col("position").cast("long").alias("position"))
    for depth in range(max_depth + 1):
        if depth:
            wave = fetched.select(*KEYS, F.col("url").alias("source"), F.col("place").cast("long").alias("page")).join(links, [*KEYS, "source"])
            wave = wave.select(*KEYS, F.col("target").alias("url"), "page", F.col("position").cast("long").alias("position"))
        found = wave.groupBy(*KEYS, "url").agg(F.min(F.struct("page", "position")).alias("at"))
        found = found.join(sites, "client").where(same_site(F.col("url"), F.col("domain")) & ~F.coalesce(excluded_path(F.col("url"), F.col("excluded")), F.lit(False)))
        if seen is not None:
            found = found.join(seen.select(*KEYS, "url"), [*KEYS, "url"], "left_anti")
        hosts = found.select("url", root_domain(F.col("url")).alias("host")).distinct()
        found = found.join(robots_allowed(hosts, rules, agent).where("allowed").select("url"), "url", "left_semi")
        new = top(found, budget, [*KEYS], [F.asc("at"), F.asc("url")])
        if seen is not None:
            new = new.join(seen.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("used")), [*KEYS]).withColumn("place", F.col("place") + F.col("used")).where(F.col("place") <= budget)
        fetched = stored(new.select(*KEYS, "url", F.lit(depth).alias("depth"), "place"), "wave")
        seen = fetched if seen is None else seen.unionByName(fetched)
        left = seen.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("used")).where(F.col("used") < budget)
        fetched = fetched.join(left.select(*KEYS), [*KEYS], "left_semi")
        if fetched.isEmpty():
            break
    return seen
