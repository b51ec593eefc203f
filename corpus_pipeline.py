"""The document pipeline: language, near duplicates, benchmark passages, personal data, packing.

Defined results: documents with a null text or without letters go in the first stage; a null doc_id stays unless its text is a near
copy of another document's; of repeated rows one stays; columns beside those of documents pass through all stages but the last as
they came; an empty table, or one whose documents name no language, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiquarry.llm import decontam, langid, packing, pii, simhash_dedup
from visiquarry.llm.common import materialize, table
from visiquarry.llm.queries import tokenizer_path

#: SQL cannot express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None
#: A document whose likeliest language has less than this calibrated probability is in no language that was learned.
LEAST_LANGUAGE_SCORE = 0.3
#: Words whose token ids a task keeps while it packs: less than alone, as earlier stages have filled the executors' heaps.
CACHED_WORDS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters go. Every column leaves as it came, whatever its name."""
    model = langid.fit(docs)
    whole = docs.select(F.struct("*").alias("d"), "text")
    kept = langid.predict(whole, model, ["d"]).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*(F.col("d")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near copies."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced and disclosing terms generalised or removed."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids."""
    return packing.pack(docs, tokenizer_path(), cache_words=CACHED_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
