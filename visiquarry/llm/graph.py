"""Connected components: forests of shares of the links, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: links of a task that makes their forest
SHARE = 1 << 18


def forest(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, the smallest node that these links join it with) of all nodes but the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    x, y = at[: len(hi)], at[len(hi) :]
    least = np.arange(len(nodes))
    while len(x):
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
        x, y = least[x], least[y]
        x, y = x[x != y], y[x != y]
    own = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[own], nodes[least[own]]


def _forests(links: DataFrame, shares: int) -> DataFrame:
    """(hi, lo): the forests of so many shares of the links. A task holds no more than two shares' links at once."""
    most = 2 * SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            hi, lo = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("hi", "lo"))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(hi, lo)], names=["hi", "lo"])

        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > most:
                yield told()
                held = []
            held.append(batch)
        if held:
            yield told()

    return arrow_map(links.select("hi", "lo").coalesce(shares), run, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node) for every node of the long pairs (a, b).

    Links are dealt out in shares of about ``SHARE``, whose forests take their place; a single share needs no round after that.
    Every round is two joins with a table of minima by node, so a node with very many links is summed before the shuffle
    and its join can be split. Rounds are written to the shared folder; the loop ends when all links are stars: no node is on
    both sides, and every one has one centre. A sum by node says so, without another round.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    shares = max(1, -(-links.count() // SHARE))
    forests = _forests(links, shares)
    stars = materialize(forests.distinct() if shares > 1 else forests, "forests")
    while shares > 1 and not _are_stars(stars):
        both = stars.union(stars.select("lo", "hi")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(low.where("m < u").select("u", "m")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).distinct()
        stars = materialize(small, "stars")
    found = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _are_stars(stars: DataFrame) -> bool:
    sides = stars.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select("lo", F.lit(0), F.lit(1)))
    return sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
