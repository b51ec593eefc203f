"""Document fingerprints by winnowing, in DataFrame functions alone.

Texts are lower-cased and cut into words (runs without white space, in pieces of at most 16 characters). A gram is GRAM = 4
words; its hash is a cyclic polynomial over the words' hashes, h1 rotated by 3, h2 by 2, h3 by 1 and h4, combined by
exclusive or, built in two passes of which the second uses the sums of the first. Of every WINDOW = 8 neighbouring grams the
least hash is kept, the rightmost of equal ones, with its place. So any GRAM + WINDOW - 1 = 11 words that two texts share
give them a common hash. A kept gram is one long: 39 bits of hash above 24 bits that hold 2**24 - 1 - place (modulo 2**24).

Defined results: a null text counts as empty; a text of fewer than GRAM words has the hash of its whole; one of fewer than
WINDOW grams keeps their least. Documents follow one another by doc_id, null ids first, equal ids by a hash of their text;
the only document of a table follows itself; repeated rows each have a result; an empty table gives no rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

GRAM, WINDOW = 4, 8
PLACE_BITS = 24
PIECE = 16
_LAST = (1 << PLACE_BITS) - 1
_NULL_ID = -(2**63)


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.lit(_LAST).cast("long") - place.bitwiseAND(F.lit(_LAST)).cast("long"))


def _with_later(a: str, step: int) -> Column:
    return F.transform(a, lambda x, i: F.least(x, F.get(F.col(a), i + step)))


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the kept grams of column ``text`` in order of place. Every pass is a column of its own, so none is made twice."""
    a, n = f"__{out}", f"__{out}_n"
    passes = [
        F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0)), lambda w: F.xxhash64(w)),
        F.transform(a, lambda x, i: _rotated(x, 1).bitwiseXOR(F.get(F.col(a), i + 1))),
        F.transform(a, lambda x, i: _rotated(x, 2).bitwiseXOR(F.get(F.col(a), i + 2))),
    ]
    for p in passes:
        df = df.withColumn(a, p)
    df = df.withColumn(n, F.size(a) - (GRAM - 1))
    df = df.withColumn(a, F.when(F.col(n) > 0, F.slice(F.col(a), F.lit(1), F.greatest(F.col(n), F.lit(0)))).otherwise(F.array(F.xxhash64(text))))
    df = df.withColumn(a, F.transform(a, lambda h, i: _packed(h, i)))
    for step in (1, 2, 4):  # least() passes over what lies behind the end
        df = df.withColumn(a, _with_later(a, step))
    return df.withColumn(out, F.array_distinct(F.slice(F.col(a), F.lit(1), F.greatest(F.col(n) - (WINDOW - 1), F.lit(1))))).drop(a, n)


def hashes(kept: str) -> Column:
    """The different hashes of kept grams, without places."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, PLACE_BITS)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes."""
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    return both / (F.size(a) + F.size(b) - both)


def written(kept: str) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.hex(x)), ",")


def _bucket(x: Column, bounds: list[int]) -> Column:
    """How many bounds are at most x, in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    width = isqrt(len(bounds)) + 1
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    literal = lambda own: F.array(*(F.lit(v).cast("long") for v in own))
    coarse = F.size(F.filter(literal([r[0] for r in rows]), lambda b: b <= x))
    fine = F.size(F.filter(F.element_at(F.array(*map(literal, rows)), F.greatest(coarse, F.lit(1))), lambda b: b <= x))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)


def in_order(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, tie, bucket, ghost, and the window that has each document's successor next to it.

    Documents are dealt into buckets by ranges of doc_id. The first document of a bucket also comes last (ghost = 1) in the
    bucket before it, and the first of all in the last one.
    """
    n = 4 * partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), text.alias("text"))
    bounds = rows.select("id").stat.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)
    rows = rows.withColumn("bucket", _bucket(F.col("id"), sorted({int(b) for b in bounds}))).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("bucket").agg(F.min("id").alias("id"))  # one row for each bucket
    order = Window.orderBy("bucket")
    heads = heads.select("bucket", "id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    firsts = rows.join(F.broadcast(heads), ["bucket", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("tie"))).where("place = 1")
    every = rows.withColumn("ghost", F.lit(0)).select("doc_id", "id", "text", "bucket", "tie", "ghost").union(firsts.select("doc_id", "id", "text", F.col("to").alias("bucket"), "tie", F.lit(1)))
    return every, Window.partitionBy("bucket").orderBy("ghost", "id", "tie")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and ``kept``, the winnowed grams of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return winnow(docs.select("doc_id", text.alias("text")), "text", "kept").select("doc_id", "kept")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to one another and to the next document's.

    The edited text has the last quarter of the characters replaced by as many from the start of the next document.
    """
    every, window = in_order(docs)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    df = every.withColumn("next", F.lead("text").over(window)).withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - quarter), F.left(F.coalesce("next", F.lit("")), quarter)))
    df = winnow(winnow(df.drop("next"), "text", "kept"), "edited", "edited_kept")
    df = df.select("doc_id", "id", "bucket", "tie", "ghost", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "kept", "edited_kept", hashes("kept").alias("own"), hashes("edited_kept").alias("changed"))
    df = df.withColumn("following", F.lead("own").over(window)).where("ghost = 0")
    return df.select("doc_id", "n_chars", "edited_sha256", "kept", "edited_kept", likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))
