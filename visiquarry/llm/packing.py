"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / max_len) pieces of max_len tokens and one piece for every set bit of the
rest, longest first. Every piece is a sequence of its own whose length is a power of two, so no sequence holds tokens of
two documents and none needs padding; sequences of equal length share a bucket. The job is one scan: no row moves.

Defined results: a null or empty text has the end token alone (one piece of length 1); repeated rows are packed as often
as they occur; a null doc_id is kept; an empty table gives no rows; extra input columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, rows_in

MAX_LEN = 4096
END_ID = 2
CACHE_WORDS = 500_000

# Letters, numbers and spaces among the code points below U+0250, as the tokenizer's own pattern classes have them.
_LETTER = "a-zªµºß-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = r"\t-\r \x85\xa0"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
# UTF-8 bytes of the code points below U+0240, without the four separators that str.split takes for spaces.
_LATIN_BYTES = bytes([*range(0x1C), *range(0x20, 0x80), *range(0x80, 0xC0), *range(0xC2, 0xC9)])

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids array<int>"


class WordEncoder:
    """Token ids of texts. Words repeat, and the tokenizer treats every word apart, so ids are kept by word
    and by run between spaces.

    Texts with code points outside the Latin blocks or with a control string go to the tokenizer as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.limit = cache_words
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, ids in zip(parts, self._ids([" ".join(p) for p in parts])):
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.cache.update((w, raw[i:j]) for w, i, j in zip(part, [0, *cuts], cuts))
            else:
                self.cache.update((w, x.tobytes()) for w, x in zip(part, self._ids(part)))

    def _learn_chunks(self, chunks: list[str]) -> None:
        alone, rest = [], []
        for c in chunks:
            (alone if c.isalpha() else rest).append(c)
        words = list(map(_WORDS.findall, rest))
        self._learn(list({*alone, *chain.from_iterable(words)}.difference(self.cache)))
        get = self.cache.__getitem__
        self.cache.update([(c, b"".join(map(get, own))) for c, own in zip(rest, words)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.limit:  # early words are the frequent ones
            self.cache = dict(islice(self.cache.items(), self.limit // 2))
        plain = ["<|" not in t and not t.encode("utf-8", "surrogatepass").translate(None, _LATIN_BYTES) for t in texts]
        chunks = [t.lower().split() if ok else () for t, ok in zip(texts, plain)]
        found = [list(map(self.cache.get, own)) for own in chunks]
        new = {c for own, got in zip(chunks, found) if None in got for c, ids in zip(own, got) if ids is None}
        if new:
            self._learn_chunks(list(new))
            get = self.cache.__getitem__
            found = [[get(c) if ids is None else ids for c, ids in zip(own, got)] if None in got else got for own, got in zip(chunks, found)]
        return [np.frombuffer(b"".join(got), np.uint32) if ok else self._ids([t])[0] for t, got, ok in zip(texts, found, plain)]


def pieces(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then the set bits of the rest from high to low."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents, a row each: where it starts in its document, length, bucket (log2), ids, sequence and offset."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, cache_words)
        for batch in rows_in(batches, 128):
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for length in pieces(len(ids), max_len):
                    part = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids), length.bit_length() - 1, part.astype(np.int32) if with_ids else None))
                    start += length
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"])

    cut = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)
    return cut.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
