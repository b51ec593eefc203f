"""Language-model scores from a weighted backoff automaton of order three.

Learning counts words (N tokens, V different ones; every text ends with an end token), pairs and triples. With
p1(w) = (c(w) + 1) / (N + V + 1), a Dirichlet prior smooths every longer history by the next shorter one:
p(w | h) = (c(h w) + PRIOR[0] p1(w)) / (c(h) + PRIOR[0]) and p(w | g h) = (c(g h w) + PRIOR[1] p(w | h)) / (c(g h) + PRIOR[1]).
The probabilities after any history sum to one, as every word but the end is followed by exactly one token.

The automaton (``Automaton``) has a state for the start of a text, for every word, for every pair and the empty one. Every
n-gram seen, once or more, is an arc with its smoothed probability; a state's failure arc, of weight PRIOR / (c + PRIOR), leads
to the state of the shorter history, and the empty state has an arc for every word, known or not. A text is read once from left
to right: each token takes the arc of the state that is carried, after as many failure arcs as it needs, and the weights of
all arcs taken add up to the score. Texts of a chunk are walked side by side, long ones in pieces: a state holds two tokens
at most, so a piece that first reads the two tokens before it, unweighted, is in the state of the whole text.

Nothing that grows with the corpus is gathered in one place. Documents are dealt into chunks of about ``CHUNK_BYTES``. Each
chunk tells its distinct n-grams with their counts in its learning texts, sorted and cut into ranges of the hash ("parts");
a task adds the counts of one part over all chunks and answers each chunk in the order of its own n-grams, and the chunk
builds the parts of the automaton that its texts can reach, some texts at a time. Words are known by 63-bit hashes, pairs and triples by 56 bits. N and V
are the only figures that go to the driver.

Defined results: a null text counts as empty (its end token alone); a null doc_id is learned from and not held out; repeated
rows are learned as often as they occur; without learning documents N and V are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import gaps, keys_of, packed, parts_of, unpacked
from .common import arrow_map, partitions, rows_in
from .words import BASE, MIX, START, Words, mixed

PRIOR = (1000.0, 3.0)
CHUNK_BYTES = 16 << 20
LANE = 256
TOKENS_AT_ONCE = 1 << 19
WORD_BITS, GRAM_BITS = 63, 56
WIDTHS = (WORD_BITS, GRAM_BITS, GRAM_BITS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def ngrams(tokens: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, text of each) of words with the starts of texts, of pairs, and of triples, which the first token has none of."""
    text = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    yield np.concatenate([tokens, np.full(len(n), START)]), np.concatenate([text, np.arange(len(n))])
    before = np.roll(tokens, 1)
    before[first] = START
    pairs = mixed(before * BASE + tokens)
    yield pairs >> np.uint64(64 - GRAM_BITS), text
    rest = np.ones(len(tokens), bool)
    rest[first] = False
    yield mixed(np.roll(pairs, 1) * MIX + tokens)[rest] >> np.uint64(64 - GRAM_BITS), text[rest]


def counted(keys: np.ndarray, learning: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs in learning texts."""
    s = np.sort(keys << np.uint64(1) | ~learning)
    own = s >> np.uint64(1)
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[head], np.add.reduceat((s & np.uint64(1)) == 0, head, dtype=np.int64) if len(head) else head


def even_labels(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers of which hash partitioning puts one into each of n partitions."""
    tried = spark.range(int(n * (np.log(n) + 8))).select(F.col("id").cast("int").alias("label"))
    rows = tried.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("p")).agg(F.min("label").alias("label")).collect()
    found = {r["p"]: r["label"] for r in rows}
    spare = iter(range(-1, -n - 1, -1))  # a partition that no number met; not more than a few in a million
    return np.array([found[p] if p in found else next(spare) for p in range(n)], np.int32)


def vocabulary(texts: DataFrame, n_parts: int) -> tuple[int, int]:
    """(tokens, different ones) of the texts. Tasks send sorted distinct hashes by part, and a part is merged in one task."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, tokens = Words(), [], 0

        def flush() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            cut = parts_of(keys, WORD_BITS, n_parts).tolist()
            rows = [(p, gaps(keys[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([tokens] * (len(rows) > 0) + [0] * (len(rows) - 1), pa.int64())],
                names=["part", "words", "n"],
            )

        for batch in rows_in(batches):
            if batch.num_rows:
                own, n = words.read(batch.column("text").to_pylist())
                tokens += len(own)
                held.append(np.unique(own))
                if sum(map(len, held)) > 4 << 20:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > 2 << 20:
                        yield flush()
                        held, tokens = [], 0
        if held:
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        every = [keys_of(b) for b in rows.column("words").to_pylist()]
        return pa.table({"types": pa.array([len(np.unique(np.concatenate(every)))], pa.int64()), "tokens": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    told = arrow_map(texts.select("text"), tell, "part int, words binary, n long")
    row = told.groupBy("part").applyInArrow(merge, "types long, tokens long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def distinct_ids(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(place of each key among the distinct ones in order, how many these are)."""
    order = np.argsort(keys)
    s = keys[order]
    at = np.empty(len(s), np.int32)
    at[order] = np.cumsum(np.append(True, s[1:] != s[:-1])[: len(s)]) - 1
    return at, int(at[order[-1]]) + 1 if len(s) else 0


class Automaton:
    """The states and arcs that the texts of a chunk can reach.

    ids: for every token its word (then the start of each text), its pair and, but for first tokens, its triple, as places
    among the distinct ones; counts: of these distinct ones in all learning texts. State 0 is the empty history; an arc is
    known by its state and word, sorted. An n-gram never learned has no state and no arc.
    """

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray, below: int, prior: tuple[float, float] = PRIOR) -> None:
        (words, pairs, triples), (c1, c2, c3) = ids, counts
        size, first = int(n.sum()), np.cumsum(n) - n
        self.words = words[:size]
        before = np.roll(self.words, 1)
        before[first] = words[size:]
        rest = np.ones(size, bool)
        rest[first] = False
        rest = np.flatnonzero(rest)
        # a token that ends each pair and each triple stands for all of them
        at2, at3 = np.zeros(len(c2), np.int64), np.zeros(len(c3), np.int64)
        at2[pairs] = np.arange(size)
        at3[triples] = rest
        history, word2 = before[at2], self.words[at2]
        earlier, later, word3 = pairs[at3 - 1], pairs[at3], self.words[at3]

        self.n_words, n1 = len(c1), int((c1 > 0).sum())
        word_state = np.where(c1 > 0, np.cumsum(c1 > 0), 0).astype(np.int32)
        pair_state = np.where(c2 > 0, n1 + np.cumsum(c2 > 0), word_state[word2]).astype(np.int32)
        self.start = word_state[words[size:]]
        self.failure = np.concatenate([np.zeros(1 + n1, np.int32), word_state[word2[c2 > 0]]])
        self.failure_weight = np.log10(np.concatenate([np.ones(1), prior[0] / (c1[c1 > 0] + prior[0]), prior[1] / (c2[c2 > 0] + prior[1])]))

        def sorted_arcs(source, word, target, p):
            arcs = source.astype(np.int64) * self.n_words + word
            order = np.argsort(arcs)
            return arcs[order], target[order], np.log10(p)[order]

        # states are numbered by the length of their histories, so the arcs of one length after the other are in order
        p1 = (c1 + 1) / below
        p2 = (c2 + prior[0] * p1[word2]) / (c1[history] + prior[0])
        levels = [sorted_arcs(np.zeros(self.n_words), np.arange(self.n_words), word_state, p1)]
        seen = np.flatnonzero(c2)
        levels.append(sorted_arcs(word_state[history[seen]], word2[seen], pair_state[seen], p2[seen]))
        seen = np.flatnonzero(c3)
        earlier, later, word3 = earlier[seen], later[seen], word3[seen]
        levels.append(sorted_arcs(pair_state[earlier], word3, pair_state[later], (c3[seen] + prior[1] * p2[later]) / (c2[earlier] + prior[1])))
        self.arcs, self.target, self.weight = (np.concatenate(x) for x in zip(*levels))

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after a word each, log10 of its probability): failure arcs until the word has an arc; the empty state has all."""
        after, weight = states.copy(), np.zeros(len(states))
        left = np.arange(len(states))
        while len(left):
            asked = after[left].astype(np.int64) * self.n_words + words[left]
            place = np.searchsorted(self.arcs, asked)
            known = self.arcs[np.minimum(place, len(self.arcs) - 1)] == asked
            taken, place, left = left[known], place[known], left[~known]
            after[taken] = self.target[place]
            weight[taken] += self.weight[place]
            weight[left] += self.failure_weight[after[left]]
            after[left] = self.failure[after[left]]
        return after, weight

    def walk(self, n: np.ndarray, lane: int = LANE) -> np.ndarray:
        """log10 probability of each text."""
        pieces = -(-n // lane)
        text = np.repeat(np.arange(len(n)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, length = (np.cumsum(n) - n)[text] + number * lane, np.minimum(lane, n[text] - number * lane)
        order = np.argsort(-length, kind="stable")
        text, number, at, length = text[order], number[order], at[order], length[order]
        state, total = self.start[text], np.zeros(len(text))
        later = np.flatnonzero(number)
        state[later] = 0
        for back in (2, 1):
            state[later], _ = self.step(state[later], self.words[at[later] - back])
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for t, k in enumerate(active.tolist()):
            state[:k], weight = self.step(state[:k], self.words[at[:k] + t])
            total[:k] += weight
        return np.bincount(text, total, len(n))


def walk_parts(ids: list[np.ndarray], counts: list[np.ndarray], n: np.ndarray, below: int, most: int = TOKENS_AT_ONCE) -> np.ndarray:
    """log10 probability of each text of a chunk, by automata of the texts of about ``most`` tokens each, one after the other.

    An automaton takes some 250 bytes a token, so that of a whole chunk would fill an executor beside its other tasks.
    """
    ends = np.cumsum(n)
    out, lo = np.zeros(len(n)), 0
    while lo < len(n):
        begin = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + most, "right")))
        end = int(ends[hi - 1])
        words, pairs, triples = ids
        # the starts of texts stand behind all words, and first tokens have no triple
        own = [np.concatenate([words[begin:end], words[len(pairs) + lo : len(pairs) + hi]]), pairs[begin:end], triples[begin - lo : end - hi]]
        met = [np.unique(x, return_inverse=True) for x in own]
        part = Automaton([at.astype(np.int32) for _, at in met], [c[x] for c, (x, _) in zip(counts, met)], n[lo:hi], below)
        out[lo:hi] = part.walk(n[lo:hi])
        lo = hi
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Counts and scores for every document; learning leaves out those that ``held_out`` names."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_chunks = max(partitions(spark), -(-int(size) // chunk_bytes))
    tokens, types = vocabulary(given.where("not held_out"), n_chunks)
    below = tokens + types + 1
    labels = even_labels(spark, n_chunks)
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int")
    dealt = given.withColumn("chunk", F.element_at(F.lit(labels), number + 1)).repartition(n_chunks, "chunk")

    def tell(docs: pa.Table) -> pa.Table:
        learning = ~docs.column("held_out").to_numpy()
        keys, own, cuts = [], [], []
        for bits, (every, text) in zip(WIDTHS, ngrams(*Words().read(docs.column("text").to_pylist()))):
            k, c = counted(every, learning[text])
            keys.append(k)
            own.append(c)
            cuts.append(parts_of(k, bits, n_chunks).tolist())
        every = [(p, [(c[p], c[p + 1]) for c in cuts]) for p in range(n_chunks)]
        rows = [(p, cut) for p, cut in every if any(a < b for a, b in cut)]
        blobs = {f"k{o}": pa.array([gaps(keys[o][cut[o][0] : cut[o][1]]) for _, cut in rows], pa.binary()) for o in range(3)}
        blobs |= {f"n{o}": pa.array([packed(own[o][cut[o][0] : cut[o][1]]) for _, cut in rows], pa.binary()) for o in range(3)}
        chunk = docs.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([labels[p] for p, _ in rows], pa.int32()), "part": pa.array([p for p, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), **blobs})

    def add(asked: pa.Table) -> pa.Table:
        """Counts that the other chunks have of each chunk's n-grams, in the order told."""
        out = {c: asked.column(c) for c in ("chunk", "part")}
        for o in range(3):
            every = [keys_of(b) for b in asked.column(f"k{o}").to_pylist()]
            own = [unpacked(b) for b in asked.column(f"n{o}").to_pylist()]
            ends, keys, counts = np.cumsum([0, *map(len, every)]).tolist(), np.concatenate(every), np.concatenate(own)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            sums = np.add.reduceat(counts[order], head) if len(head) else counts
            counts[order] = np.repeat(sums, np.diff(np.append(head, len(keys)))) - counts[order]
            out[f"m{o}"] = pa.array([packed(counts[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
        return pa.table(out)

    def read(docs: pa.Table, answers: pa.Table) -> pa.Table:
        seq, n = Words().read(docs.column("text").to_pylist())
        learning = ~docs.column("held_out").to_numpy()
        answers = answers.sort_by("part")
        ids, counts = [], []
        for o, (every, text) in enumerate(ngrams(seq, n)):
            at, size = distinct_ids(every)
            more = np.concatenate([unpacked(b) for b in answers.column(f"m{o}").to_pylist()])
            if len(more) != size:
                raise ValueError("a chunk's texts changed between two reads")
            ids.append(at)
            counts.append(np.bincount(at, learning[text], size).astype(np.int64) + more.astype(np.int64))
        del every, text, at, more
        c1 = counts[0][ids[0][: len(seq)]]
        total = lambda x: np.add.reduceat(x, np.cumsum(n) - n)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
            "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(total((c1 > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()),
            "base_score": pa.array(total(np.log10((c1 + 1) / below)), pa.float64()), "score": pa.array(walk_parts(ids, counts, n, below), pa.float64()),
        })

    asked = dealt.groupBy("chunk").applyInArrow(tell, "bucket int, part int, chunk int, k0 binary, k1 binary, k2 binary, n0 binary, n1 binary, n2 binary")
    answers = asked.repartition(n_chunks, "bucket").groupBy("bucket").applyInArrow(add, "chunk int, part int, m0 binary, m1 binary, m2 binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(read, RESULT)
