"""Personal data: fixed rules for identifiers, and information-theoretic sanitisation of the terms that reveal them.

Protected entities e are every identifier that a rule finds (its kind and normalised value) and, for each kind, the fact that
a document holds such an identifier. Terms t are the words outside identifiers. Over the whole corpus, with N documents and
n(e), n(t), n(e, t) that hold e, t and both, anywhere in their whole texts, a term discloses
PMI(e; t) = log2(N n(e, t) / (n(e) n(t))) bits of the IC(e) = log2(N / n(e)) bits that e carries. A term whose share
PMI / IC reaches ``remove_at`` is removed, one that reaches ``generalise_at`` is replaced by a class name, wherever it stands
in the texts that hold e; a text without e has nothing that the term could reveal and stays as it is. Only pairs seen in
``min_support`` different texts count as evidence, so copies of one text prove nothing.

Defined results: a null text counts as empty and has no spans; a null doc_id is kept; repeated rows each get their own
result row and count as documents of their own; an entity that all documents hold (IC 0) discloses nothing; a term that two
entities want removed and generalised is removed; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, rows_in

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
GENERALISE_AT = 0.6
REMOVE_AT = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Each '@' is looked at once: the domain to its right, then the run of local characters to its left."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            i = at
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < at:
                out.append((i, last := m.end()))
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """A chain of dotted numbers holds a match in each full four of its parts."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := "".join(_DIGITS.findall(m.group()))) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]


def find_base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds, by kind as listed, then start; code points, end exclusive."""
    out = [("email", *s) for s in emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)] + [("phone", *s) for s in phones(text)]
    return out


def _entity(kind: str, value: str) -> int:
    value = value.lower() if kind in ("email", "ip") else "".join(_DIGITS.findall(value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - 2**63


def lowered(word: str) -> str:
    """In lower case, unless that changes the length."""
    low = word.lower()
    return low if len(low) == len(word) else word


def words_outside(text: str, spans: list[tuple[int, int]]) -> dict[str, list[int]]:
    """Starts of every word, in lower case, that no span touches."""
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    ends, out = [hi for _, hi in merged], {}
    for m in _TERM.finditer(text):
        k = bisect_left(ends, m.start() + 1)
        if k == len(merged) or m.end() <= merged[k][0]:
            out.setdefault(lowered(m.group()), []).append(m.start())
    return out


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


FOUND = "doc_id long, text_key long, base array<struct<kind:string,start:int,end:int,entity:long>>, words array<struct<term:string,at:array<int>>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.int64())])
_WORD = pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32()))])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: identifiers with their entity and, of texts that hold any, the words outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            base, words = [], []
            for text in batch.column("text").to_pylist():
                spans = [(k, s, e, _entity(k, text[s:e])) for k, s, e in find_base(text)] if text else []
                base.append([dict(zip(("kind", "start", "end", "entity"), x)) for x in spans])
                own = words_outside(text, [(s, e) for _, s, e, _ in spans]) if spans else {}
                words.append([{"term": t, "at": at} for t, at in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(base, pa.list_(_SPAN)), pa.array(words, pa.list_(_WORD))], names=["doc_id", "text_key", "base", "words"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key")), run, FOUND)


def term_documents(docs: DataFrame, flush_at: int = 200_000) -> DataFrame:
    """term, n_term: documents that hold each word. Tasks count what they read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in rows_in(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(set(map(lowered, set(_TERM.findall(text)))))
            if len(counts) > flush_at:
                yield flush()
        yield flush()

    return arrow_map(docs.select(F.col("text").cast("string").alias("text")), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame, texts: DataFrame, held: DataFrame, n_docs: int, min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """entity, term, share, action: the terms that reveal an entity beyond the thresholds, from counts over all documents.

    texts: text_key, entities, words, n (documents) of the different texts that hold identifiers; held: text_key, entity, n of them.
    """
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= min_support) & (F.col("n_entity") < n_docs)).select("entity", "n_entity")
    shown = held.join(entities, "entity").groupBy("text_key").agg(F.collect_list("entity").alias("entities"))
    pairs = texts.select("text_key", "n", "words").join(shown, "text_key").select("n", "entities", F.explode("words.term").alias("term")).select("n", "term", F.explode("entities").alias("entity"))
    together = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    ic = F.log2(n_docs / F.col("n_entity"))
    pmi = F.log2(n_docs * F.col("n_both") / F.col("n_entity") / F.col("n_term"))
    return (
        together.join(entities, "entity").join(term_documents(docs), "term").withColumn("share", pmi / ic).where(F.col("share") >= generalise_at)
        .select("entity", "term", "share", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"))
    )


def detect(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, text_key, base, terms: identifiers and disclosing terms of every document."""
    found = materialize(find(docs), "pii-found")
    own = found.where(F.size("base") > 0)
    copies = own.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    entities = F.array_distinct(F.concat(F.transform("base", lambda b: b["entity"]), F.transform("base", lambda b: F.xxhash64(b["kind"]))))
    texts = materialize(own.select("text_key", entities.alias("entities"), "words").dropDuplicates(["text_key"]).join(copies, "text_key"), "pii-texts")
    held = texts.select("text_key", "n", F.explode("entities").alias("entity"))
    terms = materialize(disclosing_terms(docs, texts, held, found.count(), **thresholds), "pii-terms")
    revealing = terms.groupBy("term").agg(F.collect_list(F.struct("entity", "action")).alias("by"))
    seen = texts.select("text_key", F.explode("words.term").alias("term")).join(revealing, "term")  # a word meets one row
    wanted = seen.groupBy("text_key").agg(F.collect_list(F.struct("term", "by")).alias("wanted"))
    asked = F.map_from_entries(F.transform("wanted", lambda w: F.struct(w["term"], F.array_max(F.transform(F.filter(w["by"], lambda d: F.array_contains(F.col("entities"), d["entity"])), lambda d: d["action"])))))
    own = texts.join(wanted, "text_key").select("text_key", "words", asked.alias("asked"))
    one = lambda w, a: F.struct(a.alias("start"), (a + F.length(w["term"])).cast("int").alias("end"), F.col("asked")[w["term"]].alias("action"), w["term"].alias("term"))
    places = F.flatten(F.transform(F.filter("words", lambda w: F.col("asked")[w["term"]].isNotNull()), lambda w: F.transform(w["at"], lambda a: one(w, a))))
    marked = own.select("text_key", F.array_sort(places).alias("terms"))
    return found.join(marked, "text_key", "left").select("doc_id", "text_key", "base", F.coalesce("terms", F.expr("array()")).alias("terms"))


_LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace spans (start, end, label); overlapping ones are one span with the label of the first."""
    merged: list[list] = []
    for s, e, label in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, label])
    out, at = [], 0
    for s, e, label in merged:
        out += [text[at:s], label]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents, all columns kept, with identifiers replaced by their kind and disclosing terms generalised or removed.

    Identifiers are found again where the text is; only documents with disclosing terms have a row on the join's other side.
    """
    terms = (
        detect(docs, **thresholds).where(F.size("terms") > 0)
        .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["action"].alias("action"))).alias("terms"))
        .dropDuplicates(["id", "key"])
    )

    @F.pandas_udf("string")
    def clean(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None else redact(t, [(s, e, _LABEL[k]) for k, s, e in find_base(t)] + [(x["start"], x["end"], _LABEL[x["action"]]) for x in (() if own is None else own)])
            for t, own in zip(texts, terms)
        ], dtype=object)

    whole = docs.select(F.struct("*").alias("d"), text_key(F.col("text")).alias("k"))
    joined = whole.join(terms, F.col("d.doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left")
    done = joined.select("d", clean(F.col("d.text").cast("string"), "terms").alias("clean"))
    return done.select(*(F.col("clean").alias(c) if c == "text" else F.length("clean").cast("long").alias(c) if c == "n_chars" else F.col("d")[c].alias(c) for c in docs.columns))
