"""Merkle manifest of a table of documents: leaves by language, a subroot for each, one root, and a proof for every document.

Nested-struct rollup. A document's rank within its language is written in binary digits. The low DIGITS digits are its place in
a block of at most 2^DIGITS leaves; a digit at a time, the lowest first, is grouped away within the block, and each group
becomes a node that nests the structs of its children. After the last digit one row holds a whole block with all its nodes, as
bounded as a block. The top nodes of the blocks are ranked leaves of the next round, until a language is one node; the subroots
in order of language are leaves of the same rollup once more. On the way back each block's nested structs are transformed into
paths of siblings, from the top down, and exploded: no node is joined with its siblings. Only whole blocks meet the path of
their top node, one row a block, by language and block number.

Ranks need no window over a language: rows are dealt by ranges of (language, doc_id, leaf), numbered within their range, and
shifted by what the ranges before hold, a table of one row for each range and language. Identical rows may lie in several
ranges; their order does not matter, as their leaves are equal.

Defined results: null fields are ``-`` in a leaf; null doc_ids come first in their language and are never tampered with;
documents of a null language form the first tree; repeated rows are leaves of their own; a language of one document has its
leaf as subroot; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, partitions

DIGITS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon and value; null as a dash."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, h (leaf), tampered (leaf after adding one to n_chars, where doc_id asks for it)."""
    whole = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source"), "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("long"), "text": F.col("text")}
    asked = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    # '' stands before every '=...', so a null language comes first
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(
        tree.alias("tree"), whole["doc_id"].alias("doc_id"), leaf_hash(whole).alias("h"),
        F.when(asked, leaf_hash(whole | {"n_chars": whole["n_chars"] + 1})).alias("tampered"),
    )


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with rank (from 0, within tree, by ``order``) and n (nodes of the tree)."""
    n_parts = partitions(nodes.sparkSession)
    # the salt deals out rows that are equal in all that is ordered by
    dealt = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n_parts, "tree", *order, "salt")
    placed = materialize(dealt.sortWithinPartitions("tree", *order, "salt").drop("salt").withColumn("place", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    held = placed.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    before = F.sum("rows").over(W.partitionBy("tree").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    shifts = held.select("tree", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    return placed.join(shifts, ["tree", "range"]).withColumn("rank", F.col("place") + F.col("shift")).drop("range", "place", "shift")


def pair_hash(pair: Column) -> Column:
    """Hash of the one or two nodes of a run."""
    return F.sha2(F.array_join(F.transform(pair, lambda x: x["h"]), ""), 256)


def rollup(nodes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row a block: tree, rank (block number), h (its top node), n (blocks of the tree), levels, kids (nested children).

    ``levels`` are the levels of the tree that lie in the block: as many as it has digits, fewer in the last round of a tree.
    """
    payload = [c for c in nodes.columns if c not in ("tree", "n")]
    depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    now = nodes.select(
        "tree", F.shiftright("rank", digits).alias("block"), F.least(F.lit(digits), depth).alias("levels"), F.ceil(F.col("n") / (1 << digits)).cast("long").alias("blocks"),
        *(F.shiftright("rank", k).bitwiseAND(1).cast("byte").alias(f"d{k}") for k in range(digits)), *payload,
    ).repartition(partitions(nodes.sparkSession), "tree", "block")
    content = payload
    for k in range(digits):
        keys = ["tree", "block", "levels", "blocks", *(f"d{j}" for j in range(k + 1, digits))]
        kids = F.array_sort(F.collect_list(F.struct(f"d{k}", *content))).alias("kids")
        now = now.groupBy(*keys).agg(kids).withColumn("h", F.when(F.col("levels") > k, pair_hash(F.col("kids"))).otherwise(F.col("kids")[0]["h"]))
        content = ["h", "kids"]
    return now.select("tree", F.col("block").alias("rank"), "h", F.col("blocks").alias("n"), "levels", "kids")


def _step(kids: Column, path: Column, level: int, levels: Column) -> Column:
    """The children with their paths: a step (the sibling, null for an only child; whether it is on the left), then the parent's path."""

    def child(x: Column, i: Column) -> Column:
        alone = F.size(kids) < 2
        other = F.when(~alone, kids[F.when(i == 0, F.lit(1)).otherwise(F.lit(0))]["h"])
        step = F.array(F.struct(other.alias("h"), (i == 1).alias("left")))
        return F.struct(x.alias("node"), F.when(levels > level, F.concat(step, path)).otherwise(path).alias("path"))

    return F.transform(kids, child)


def _down(level: int) -> Callable[[Column], Column]:
    return lambda x: _step(x["node"]["kids"], x["path"], level, F.col("levels"))


def unrolled(blocks: DataFrame, upper: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every node that went into ``blocks`` with its path, from the paths of the blocks' top nodes (tree, rank, path, ...)."""
    own = blocks.select("tree", "rank", "levels", "kids").join(upper.drop("h"), ["tree", "rank"])
    own = own.withColumn("nodes", _step(F.col("kids"), F.col("path"), digits - 1, F.col("levels")))
    for level in range(digits - 2, -1, -1):
        own = own.withColumn("nodes", F.flatten(F.transform("nodes", _down(level))))
    rest = [c for c in upper.columns if c not in ("tree", "rank", "path", "h")]
    return own.select("tree", F.explode("nodes").alias("x"), *rest).select("tree", *rest, "x.node.*", F.col("x.path").alias("path")).drop("d0")


def _forest(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """Rounds of rollup, written one by one, until every tree is one node."""
    rounds = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or not rounds:
        rounds.append(materialize(rollup(nodes, digits), "merkle-blocks"))
        nodes = rounds[-1].select("tree", "rank", "n", "h")
        most = -(-most // (1 << digits))
    return rounds


def manifest(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, lang, leaf, tampered, subroot, root and path (steps from the leaf to the root) of every document."""
    rounds = _forest(ranked(leaves(docs), "doc_id", "h"), digits)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
    above = _forest(ranked(subroots, "name"), digits)
    nothing = F.array().cast("array<struct<h:string,left:boolean>>")
    paths = above[-1].select("tree", "rank", F.col("h").alias("root"), nothing.alias("path"))
    for blocks in reversed(above):
        paths = unrolled(blocks, paths, digits)
    tops = paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), F.col("h").alias("subroot"), "root", "path")
    for blocks in reversed(rounds):
        tops = unrolled(blocks, tops, digits)
    return tops.select("doc_id", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang"), F.col("h").alias("leaf"), "tampered", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path lead to."""

    def up(h: Column, step: Column) -> Column:
        other = F.coalesce(step["h"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(other, h)).otherwise(F.concat(h, other)), 256)

    return F.aggregate(path, start, up)


def proofs(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where there is one) and verified."""
    made = manifest(docs, digits)
    siblings = F.array_join(F.transform("path", lambda x: F.coalesce(x["h"], F.lit(""))), "")
    out = made.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
