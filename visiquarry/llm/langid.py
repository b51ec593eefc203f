"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, and n-grams of one to three characters are
hashed into ``DIM`` columns. Document frequencies come from all learning documents, counted in tasks and summed by Spark.
The weights are fitted by follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) on a sample of at most
about ``PER_LANG`` documents of each language, and a temperature is then fitted on the part of the sample left out.
Prediction reads every whole text once and moves no rows.

Defined results: a text that is null or has no letter gets ``und`` with score 1; where no document has a language, every
document gets ``und`` with score 0; languages that are null are not learned; repeated rows are predicted alike; a null
doc_id is neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_in

DIM = 1 << 16
PER_LANG = 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.05, 3
UND = "und"
BLOCK = 1 << 18

_SPACE = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


class Features:
    """Counts of hashed n-grams of whole texts, block by block."""

    def __init__(self) -> None:
        self.letter = _letters()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Columns and their counts; None if there is no letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(codes, 65535)]
        if high := np.flatnonzero(codes > 65535).tolist():
            letter[high] = [chr(codes[i]).isalpha() for i in high]
        if not letter.any():
            return None
        codes = np.where(letter, codes, np.uint32(_SPACE))
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]
        codes = np.concatenate([[np.uint32(_SPACE)], codes[keep], [np.uint32(_SPACE)]]).astype(np.uint32)
        total = None if len(codes) < 4096 else np.zeros(DIM, np.int64)
        parts = []
        for at in range(0, len(codes), BLOCK):
            c = codes[at : at + BLOCK + 2]
            first = c[:BLOCK] * np.uint32(2654435761)
            two = (first[: len(c) - 1] ^ (c[1:][: len(first)] * np.uint32(2246822519)))[: len(c) - 1]
            three = two[: max(len(c) - 2, 0)] ^ (c[2:] * np.uint32(3266489917))[: max(len(c) - 2, 0)]
            for salt, h in enumerate((first[: len(c)], two, three)):
                h = (h + np.uint32(0x9E3779B9 * (salt + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                h = (h ^ (h >> np.uint32(13))) >> np.uint32(8)
                parts.append((h & np.uint32(DIM - 1)).astype(np.int64))
            if total is not None:
                total += np.bincount(np.concatenate(parts), minlength=DIM)
                parts = []
        if total is None:
            return np.unique(np.concatenate(parts), return_counts=True)
        columns = np.flatnonzero(total)
        return columns, total[columns]

    def vector(self, text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if (got := self.counts(text)) is None:
            return None
        columns, n = got
        v = (1 + np.log(n)) * idf[columns]
        return columns, v / np.sqrt((v * v).sum())


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, features: Features, text: str | None) -> tuple[str, float]:
        if (x := features.vector(text, self.idf)) is None:
            return UND, 1.0
        if not self.langs:
            return UND, 0.0
        p = softmax(x[1] @ self.weights[x[0]] / self.temperature)
        return self.langs[k := int(p.argmax())], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that have each column: DIM sums, the last element the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, df = Features(), np.zeros(DIM + 1, np.int64)
        for batch in rows_in(batches):
            for text in batch.column("text").to_pylist():
                if (got := features.counts(text)) is not None:
                    df[got[0]] += 1
                    df[DIM] += 1
        columns = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(columns, pa.int64()), pa.array(df[columns], pa.int64())], names=["column", "n"])

    out = np.zeros(DIM + 1, np.int64)
    for column, n in arrow_map(texts.select("text"), run, "column long, n long").groupBy("column").agg(F.sum("n")).toLocalIterator():
        out[column] = n
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7) -> np.ndarray:
    """Weights by follow-the-regularised-leader-proximal, one row at a time."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    order = np.random.default_rng(seed)

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            columns, values, label = rows[i]
            zi, ni = z[columns], n[columns]
            w = solve(zi, ni)
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            more = ni + g * g
            z[columns] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[columns] = more
    return solve(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss: a grid in log space over six decades, made finer twice around its best point."""
    low, high = np.log(1e-3), np.log(1e3)
    for _ in range(3):
        grid = np.linspace(low, high, 61)
        loss = [-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
        best = int(np.argmin(loss))
        low, high = grid[max(0, best - 1)], grid[min(60, best + 1)]
    return float(np.exp(grid[best]))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from (text, lang) of all rows given: frequencies from all of them, weights from a bounded sample by hash."""
    name = F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)
    docs = docs.select(F.xxhash64(name, F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    df = document_frequencies(docs)
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((DIM, 0)), idf, 1.0)
    rate = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))))
    chosen = F.pmod("h", F.lit(1 << 40)) < F.element_at(rate, F.col("lang")) * (1 << 40)  # copies of a text have hashes of their own
    features, drawn = Features(), []
    for r in docs.where(chosen).select("h", "text", "lang").toLocalIterator():
        if (x := features.vector(r["text"], idf)) is not None:
            drawn.append((r["h"], r["lang"], x))
    # in order of their hashes, so that the table's partitions do not matter; equal hashes are equal rows
    rows = [(*x, langs.index(lang)) for _, lang, x in sorted(drawn, key=lambda d: d[:2])]
    fitted, left = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    weights = ftrl(fitted or rows, len(langs))
    logits = np.array([v @ weights[c] for c, v, _ in left]) if left else np.zeros((0, len(langs)))
    return Model(langs, weights, idf, temperature(logits, np.array([r[2] for r in left])) if left else 1.0)


def predict(docs: DataFrame, model: Model, keep: str | list[str] = "*") -> DataFrame:
    """Columns ``lang_pred`` and ``score`` for every document, beside those of ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in rows_in(batches):
            got = [model.predict(features, t) for t in batch.column("__text").to_pylist()]
            own = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*own, "lang_pred", "score"])

    rest = docs.select(*keep) if isinstance(keep, list) else docs
    rest = rest.drop("lang_pred", "score")
    given = docs.select(*(F.col(c) for c in rest.columns), F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return arrow_map(given, run, f"{schema}, lang_pred string, score double")
