from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from visiquarry.llm import blobs, lm_score, queries
from visiquarry.llm import words as word_hashes


def brute(rows):
    """The same model from dictionaries, with constants of its own."""
    tokens = [(i, [b"<s>"] + [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] + [b"\n"]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in tokens if not held(i)]
    c = [collections.Counter(x for t in train for x in zip(*(t[k:] for k in range(size)))) for size in (1, 2, 3)]
    n, v = sum(len(t) - 1 for t in train), len([w for w, in c[0] if w != b"<s>"])
    out = []
    for i, t in tokens:
        base = score = 0.0
        for k in range(1, len(t)):
            p1 = (c[0][t[k],] + 1) / (n + v + 1)
            base += math.log10(p1)
            p = (c[1][t[k - 1], t[k]] + 1000 * p1) / (c[0][t[k - 1],] + 1000)
            if k > 1:
                p = (c[2][t[k - 2], t[k - 1], t[k]] + 3 * p) / (c[1][t[k - 2], t[k - 1]] + 3)
            score += math.log10(p)
        out.append((i, held(i), len(t) - 1, sum(c[0][w,] > 0 for w in t[1:]), n, pytest.approx(base), pytest.approx(score)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], float(str(r[5]).split(" ")[0])))


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in queries.QUERIES["op8_lm_score"](spark, sf_dir).collect()]
    assert order(got) == order(brute(rows))


def automaton(learned, asked=()):
    """(automaton of the learned texts that reaches the asked ones too, tokens of all texts, tokens of each)."""
    seq, n = word_hashes.Words().read([*learned, *asked])
    learning = np.arange(len(n)) < len(learned)
    ids, counts = [], []
    for keys, text in lm_score.ngrams(seq, n):
        at, size = lm_score.distinct_ids(keys)
        ids.append(at)
        counts.append(np.bincount(at, learning[text], size).astype(np.int64))
    tokens = seq[: int(n[: len(learned)].sum())]
    return lm_score.Automaton(ids, counts, n, len(tokens) + len(set(tokens.tolist())) + 1), seq, n


LEARNED = ["a b a b c", "a c", "b a b", "d", "a b", ""]


def test_probabilities_after_every_state_sum_to_one():
    """Over all words, the end and an unknown one; the start is no word that can follow."""
    auto, seq, n = automaton(LEARNED, ["unknown"])
    words = np.unique(auto.words)
    assert len(words) == 6 and len(auto.failure) > 12
    ends = int(auto.words[-1])
    last = set(auto.target[auto.arcs % auto.n_words == ends].tolist())  # nothing follows an end
    for state in set(range(len(auto.failure))) - last:
        _, weight = auto.step(np.full(len(words), state), words)
        assert (10**weight).sum() == pytest.approx(1)


def test_failure_arcs_are_walked():
    """After "a b" an unknown word fails from the pair to the word to the empty state, and is left there without a history."""
    auto, seq, n = automaton(LEARNED, ["a b zz a b"])
    a, b, unknown = auto.words[-6:-3]
    state = auto.start[-1:]
    for w in (a, b):
        state, _ = auto.step(state, np.array([w]))
    pair = int(state[0])
    word = int(auto.failure[pair])
    assert auto.failure[word] == 0 and len({pair, word, 0}) == 3
    after, weight = auto.step(state, np.array([unknown]))
    assert after[0] == 0
    assert weight[0] == pytest.approx(math.log10(3 / (4 + 3)) + math.log10(1000 / (5 + 1000)) + auto.weight[unknown])  # "a b" was learned four times, "b" five times
    again, _ = auto.step(after, np.array([a]))
    assert auto.failure[again[0]] == 0 and again[0] > 0  # the word's state, as no pair with the unknown word was learned


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(alphabet="abc ", max_size=60), max_size=5), st.lists(st.text(alphabet="abcz ", max_size=60), min_size=1, max_size=4), st.integers(2, 9))
def test_pieces_of_a_text_are_in_the_states_of_the_whole(learned, asked, lane):
    auto, seq, n = automaton(learned, asked)
    assert auto.walk(n, lane) == pytest.approx(auto.walk(n, 10**6))


@pytest.mark.parametrize("most", [1, 7, 20, 10**6])
def test_automata_of_some_texts_at_a_time_score_as_one_of_all(monkeypatch, most):
    seq, n = word_hashes.Words().read(LEARNED + ["a b zz a b", "b a", "", "a b a b c a b"])
    ids, counts, sizes, one = [], [], [], lm_score.Automaton
    for keys, text in lm_score.ngrams(seq, n):
        at, size = lm_score.distinct_ids(keys)
        ids.append(at)
        counts.append(np.bincount(at, text < len(LEARNED), size).astype(np.int64))
    monkeypatch.setattr(lm_score, "Automaton", lambda i, c, n, below: (sizes.append(int(n.sum())), one(i, c, n, below))[1])
    assert lm_score.walk_parts(ids, counts, n, 30, most) == pytest.approx(one(ids, counts, n, 30).walk(n))
    assert max(sizes) <= max(most, n.max()) and sum(sizes) == n.sum()


@settings(deadline=None, max_examples=30)
@given(st.lists(st.text(alphabet="abÄ \n\x0b\u2003日", max_size=40), min_size=1, max_size=6), st.sampled_from([4, 7, 1 << 19]))
def test_words_are_cut_at_ascii_space(texts, piece):
    whole, word_hashes.PIECE = word_hashes.PIECE, piece
    try:
        seq, n = word_hashes.Words().read(texts)
    finally:
        word_hashes.PIECE = whole
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    assert n.tolist() == [len(w) + 1 for w in want]
    numbers = dict(zip([x for w in want for x in [*w, b"\n"]], seq.tolist()))
    assert [numbers[x] for w in want for x in [*w, b"\n"]] == seq.tolist() and len(set(numbers.values())) == len(numbers)


@given(st.lists(st.integers(0, 2**63 - 1)))
def test_packed_numbers_come_back(values):
    assert blobs.unpacked(blobs.packed(np.array(values, np.uint64))).tolist() == values


def test_odd_and_empty_tables(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert order([tuple(r) for r in lm_score.score(odd).collect()]) == order(brute(rows))
    assert lm_score.score(empty).count() == 0


def test_rare_words_have_contexts_at_any_size(spark):
    """A pair seen once in some 150,000 tokens is an arc, however the texts are dealt into chunks."""
    rows = [(i, "common words fill the corpus " * 2000) for i in range(15)] + [(100 + i, f"zorblax quintor alone{i}") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = order(brute(rows))
    for size in (lm_score.CHUNK_BYTES, 20_000):
        assert order([tuple(r) for r in lm_score.score(frame, size).collect()]) == want


def test_gain_on_held_out_texts(spark, sf_dir):
    held = [r for r in queries.QUERIES["op8_lm_score"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.3
