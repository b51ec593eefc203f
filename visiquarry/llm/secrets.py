"""Secrets: fixed rules, and a character convolutional network over every candidate and its surroundings.

A candidate is the value of every finding of the rules, whatever its letters, and beside them every run of 6 or more token
characters that is not a plain word: it holds a digit, a sign or a capital after a small letter, has LONG characters or more, or
stands behind a colon or an equals sign. A run that ends in an equals sign before a quote is a name, no candidate. The network reads the LEFT characters before it, the candidate (a long one in overlapping windows of WIDTH, the highest
score counts) and the RIGHT characters after it. It is trained on labelled findings, all different candidates of the table: those that a rule matched are positive, others negative. They are
dealt out by hash in shares of about ``SHARE``; an epoch goes through every share from the same weights, and the weights that come out are
averaged for the next one. Beside a share stand ``MADE`` findings of either label made from the public formats of keys, tokens and passwords and of numbers, dates, names and paths, in
surroundings taken from the share. Half of the positive ones are shown without surroundings, so that the network cannot lean
on a keyword. Scores are calibrated on a fifth left out of training (Platt scaling), and the threshold is the highest one
that finds ``RECALL`` of the labelled findings there. The network adds the span of every candidate that it accepts, the bare
value where a rule found a name with its value; spans of the rules stay.

Defined results: a null text counts as empty; a table without candidates gives no added spans; a null doc_id is kept;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, rows_in

KINDS = ("assign", "access", "hex")
LEFT, WIDTH, RIGHT = 24, 64, 16
STEP = 48
LONG = 20
SHARE = 8192
MADE = 1500
RECALL = 0.98
EPOCHS = 4
#: places of a score's histogram, a 256th apart
PLACES, A_UNIT = 1 << 14, 256

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_ODD = re.compile(rf"""[0-9+/_=]|[a-z][A-Z]|(?<=[:=])["'\x20]{{0,3}}[A-Za-z.-]{{6}}|[A-Za-z.-]{{{LONG}}}""")
_TOKENS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def find_base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three kinds by start, then kind as listed; code points, end exclusive."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def odd_runs(text: str) -> list[tuple[int, int]]:
    """Each odd place is looked at once, and the run around it taken."""
    out, at = [], 0
    while m := _ODD.search(text, at):
        lo = m.end() - 1
        while lo > at and text[lo - 1] in _TOKENS:
            lo -= 1
        hi = _TOKEN.match(text, lo).end()
        while lo < hi and text[lo] in ".=-":  # signs around a token, as in key=value, are not of it
            lo += 1
        end = hi
        while end > lo and text[end - 1] in ".-":
            end -= 1
        name = text[end - 1 : end] == "=" and text[hi : hi + 1] in ('"', "'")
        if end - lo >= 6 and not name:
            out.append((lo, end))
        at = hi
    return out


def value_of(text: str, lo: int, hi: int) -> tuple[int, int]:
    """A value without the signs around it, where 6 characters or more are left."""
    a, b = lo, hi
    while a < b and text[a] in ".=-":
        a += 1
    while b > a and text[b - 1] in ".-":
        b -= 1
    return (a, b) if b - a >= 6 else (lo, hi)


def meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of some spans, in order and apart from each other, shares a character with another span."""
    i = bisect_right(spans, start, key=itemgetter(1))
    return i < len(spans) and spans[i][0] < end


def candidates(text: str) -> list[tuple[int, int]]:
    """Values behind names, runs apart from these findings, and findings that neither holds; by start."""
    spans = find_base(text)
    named = [(s, e) for kind, s, e in spans if kind == "assign"]
    out = [value_of(text, _ASSIGN.match(text, s).start(1), e) for s, e in named]
    out = sorted(out + [run for run in odd_runs(text) if not meets(named, *run)])
    return sorted({*out, *((s, e) for kind, s, e in spans if kind != "assign" and not meets(out, s, e))})


def windows(left: str, body: str, right: str) -> list[tuple[str, str, str]]:
    """The candidate with its surroundings, cut where it is longer than WIDTH; the last window ends with it."""
    starts = [*range(0, len(body) - WIDTH, STEP), max(0, len(body) - WIDTH)]
    return [((left + body[:a])[-LEFT:], body[a : a + WIDTH], (body[a + WIDTH :] + right)[:RIGHT]) for a in starts]


def codes(left: str, body: str, right: str) -> np.ndarray:
    """LEFT + WIDTH + RIGHT small integers: what precedes the candidate, the candidate, what follows; the candidate by a table of its own."""
    around = lambda s: [1 + min(ord(c) - 32, 94) if 32 <= ord(c) < 127 else 96 for c in s]
    a, b, c = around(left[-LEFT:]), [97 + min(ord(c) - 32, 94) for c in body[:WIDTH]], around(right[:RIGHT])
    return np.array([0] * (LEFT - len(a)) + a + b + [0] * (WIDTH - len(b)) + c + [0] * (RIGHT - len(c)), np.int16)


def made_findings(n: int, around: list[tuple[str, str]], seed: int = 17) -> list[tuple[str, str, str, bool]]:
    """(left, body, right, secret): n of either label in the public formats of either kind, in the surroundings given."""
    r = np.random.default_rng(seed)
    low, up, dec = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, a, b=None: "".join(r.choice(list(chars), int(r.integers(a, (b or a) + 1))))
    word = lambda: some("aeiou" + low, 2, 9)
    secret = [
        lambda: some(dec + "abcdef", *[(32, 32), (40, 40), (64, 64), (24, 48)][int(r.integers(4))]), lambda: some(dec + "ABCDEF", 24, 64),
        lambda: some(low + up + dec + "+/", 20, 60) + "=" * int(r.integers(3)), lambda: some(low + up + dec, 16, 40), lambda: some(low + up + dec + "_-", 20, 60),
        lambda: "AKIA" + some(up + dec, 16), lambda: "eyJ" + some(low + up + dec + "_-", 20, 40) + "." + some(low + up + dec + "_-", 20, 60),
        lambda: some(low + up, 3, 6) + some(dec, 2, 4) + some(low + up + dec + "_+=", 4, 8), lambda: some(low, 2, 4) + "_" + some(low + up + dec, 24, 40),
    ]
    plain = [
        lambda: some(dec, 6, 19), lambda: f"{some(dec, 4)}-{some(dec, 2)}-{some(dec, 2)}", lambda: ".".join(some(dec, 1, 3) for _ in range(int(r.integers(3, 5)))),
        lambda: "_".join(word() for _ in range(int(r.integers(2, 4)))), lambda: "".join(word().capitalize() for _ in range(int(r.integers(2, 5)))),
        lambda: word() + "".join(word().capitalize() for _ in range(int(r.integers(1, 4)))), lambda: "/".join(word() for _ in range(int(r.integers(2, 6)))),
        lambda: f"{word()}{some(dec, 1, 3)}.{word()}.{some(low, 2, 3)}", lambda: "-".join(word() for _ in range(int(r.integers(2, 5)))), lambda: word() + word() + word() + some(dec, 0, 4),
        lambda: word() + "=" + some(dec, 1, 6), lambda: word() * 3,
    ]
    out = []
    for kinds, label in ((secret, True), (plain, False)):
        for i in range(n):
            left, right = around[int(r.integers(len(around)))] if around else ("", "")
            out.append((left, kinds[i % len(kinds)](), right, label))
    return out


SYMBOLS, EMBED, FILTERS, SPAN = 97 + 95, 8, 24, 5


@dataclass
class Network:
    """Embedding, one convolution, rectifier, maximum and mean over the places, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.3, (SYMBOLS, EMBED))
        embed[0] = 0
        return Network(embed, r.normal(0, 0.25, (SPAN * EMBED, FILTERS)), np.zeros(FILTERS), np.append(r.normal(0, 0.2, 2 * FILTERS), 0.0))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.embed[x]
        n = x.shape[1] - SPAN + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(SPAN)], axis=2)
        h = np.maximum(cols @ self.kernel + self.bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], axis=1)
        return pooled @ self.out[:-1] + self.out[-1], (cols, h, top, pooled)

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss."""
        z, (cols, h, top, pooled) = self.forward(x)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g_out = np.append(pooled.T @ d, d.sum())
        dp = d[:, None] * self.out[:-1]
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
        dh *= h > 0
        g_kernel = np.tensordot(cols, dh, ((0, 1), (0, 1)))
        dc = dh @ self.kernel.T
        g_embed = np.zeros_like(self.embed)
        n = h.shape[1]
        for i in range(SPAN):
            np.add.at(g_embed, x[:, i : i + n], dc[:, :, i * EMBED : (i + 1) * EMBED])
        g_embed[0] = 0
        return [g_embed, g_kernel, dh.sum((0, 1)), g_out]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


def left_out(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.random.Generator]:
    """Every fifth of n rows, left out for calibration and the threshold, the others, and the generator for what follows."""
    r = np.random.default_rng(seed)
    order = r.permutation(n)
    return order[::5], np.setdiff1d(order, order[::5]), r


def fresh_state() -> np.ndarray:
    """Weights of a network, their two moments and the number of steps, as one row of numbers."""
    net = Network.fresh()
    own = np.concatenate([p.ravel() for p in (net.embed, net.kernel, net.bias, net.out)])
    return np.concatenate([own, np.zeros(2 * len(own) + 1)])


def network_of(state: np.ndarray) -> tuple[Network, list[list[np.ndarray]]]:
    """The network of a state, and views of its weights and moments."""
    net = Network.fresh()
    shapes = [p.shape for p in (net.embed, net.kernel, net.bias, net.out)]
    cuts = np.cumsum([int(np.prod(x)) for _ in range(3) for x in shapes])
    views = [x.reshape(shape) for x, shape in zip(np.split(state, cuts), 3 * shapes)]
    return Network(*views[:4]), [views[i : i + 4] for i in (0, 4, 8)]


def learn(state: np.ndarray, x: np.ndarray, y: np.ndarray, epoch: int) -> np.ndarray:
    """The state after an epoch of Adam over shuffled batches of the rows that are not left out.

    Draws go on from those of the epochs before, so that a share learns the same whether its epochs run in one task or in several.
    """
    state = state.copy()
    net, (params, m, v) = network_of(state)
    _, fitted, r = left_out(len(y))
    for _ in range(epoch):
        r.shuffle(fitted)
        r.random(len(fitted))
    r.shuffle(fitted)
    shown = r.random(len(fitted)) >= 0.5
    for i in range(0, len(fitted), 64):
        rows = fitted[i : i + 64]
        xb = x[rows].copy()
        bare = (y[rows] == 1) & ~shown[i : i + 64]
        xb[bare, :LEFT] = 0
        xb[bare, LEFT + WIDTH :] = 0
        state[-1] += 1
        t = state[-1]
        for k, g in enumerate(net.step(xb, y[rows])):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            params[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return state


def places(net: Network, x: np.ndarray) -> np.ndarray:
    """Scores before calibration, as places of a histogram."""
    z = np.concatenate([net.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
    return np.clip(np.floor(z * A_UNIT), -PLACES, PLACES).astype(np.int64)


def calibrated(net: Network, place: np.ndarray, label: np.ndarray, count: np.ndarray, recall: float) -> Network | None:
    """Platt scaling and threshold by the histogram of the rows left out; a place counts as its lower end, so the recall is kept."""
    if not count[label == 1].sum():
        return None
    z, share = place / A_UNIT, count / count.sum()
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-(net.scale * z + net.shift)))
        net.scale -= 0.05 * ((p - label) * z * share).sum()
        net.shift -= 0.2 * ((p - label) * share).sum()
    order = np.flatnonzero(label == 1)[np.argsort(z[label == 1], kind="stable")]
    upto = np.cumsum(count[order])
    at = order[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")]
    net.threshold = float(1 / (1 + np.exp(-(net.scale * z[at] + net.shift))))
    return net


def train(x: np.ndarray, y: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS) -> Network | None:
    """A network of the rows of one share."""
    if not 0 < y.sum() < len(y) or len(y) < 20:
        return None
    left, *_ = left_out(len(y))
    state = fresh_state()
    for epoch in range(epochs):
        state = learn(state, x, y, epoch)
    net, _ = network_of(state)
    return calibrated(net, places(net, x[left]), y[left], np.ones(len(left)), recall)


FOUND = "doc_id long, base array<struct<kind:string,start:int,end:int>>, cands array<struct<start:int,end:int,left:string,body:string,right:string,labelled:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_CAND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string()), ("labelled", pa.bool_())])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: spans of the rules, and all candidates with what stands around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            base, cands = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = find_base(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                kinds = [[(s, e) for own, s, e in spans if own == k] for k in KINDS]
                cands.append([
                    {"start": s, "end": e, "left": text[max(0, s - LEFT) : s], "body": text[s:e], "right": text[e : e + RIGHT], "labelled": any(meets(found, s, e) for found in kinds)}
                    for s, e in candidates(text)
                ])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(cands, pa.list_(_CAND))], names=["doc_id", "base", "cands"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FOUND)


def _rows_of(share: pa.Table, made: int) -> tuple[np.ndarray, np.ndarray]:
    """What the network sees of a share's candidates and of the findings made for it, and their labels."""
    own = sorted(zip(*(share.column(c).to_pylist() for c in ("left", "body", "right", "labelled"))))
    own += made_findings(made, [(a, c) for a, _, c, label in own if not label], 17 + share.column("share")[0].as_py())
    return np.stack([codes(a, b, c) for a, b, c, _ in own]), np.array([float(x) for *_, x in own])


def _epoch(dealt: DataFrame, state: np.ndarray, made: int, epoch: int) -> np.ndarray:
    """The mean, by rows, of the states that all shares come to from one state."""
    given = dealt.sparkSession.sparkContext.broadcast(state)

    def run(share: pa.Table) -> pa.Table:
        x, y = _rows_of(share, made)
        out = learn(given.value, x, y, epoch)
        return pa.table({"at": pa.array(np.arange(len(out), dtype=np.int32)), "value": out, "rows": np.full(len(out), len(y), np.int64)})

    told = dealt.groupBy("share").applyInArrow(run, "at int, value double, rows long")
    # rounded, as the order of a sum is not fixed
    mean = told.groupBy("at").agg(F.round(F.sum(F.col("value") * F.col("rows")) / F.sum("rows"), 14).alias("value")).collect()
    out = np.zeros(len(state))
    out[[r["at"] for r in mean]] = [r["value"] for r in mean]
    return out


def fit(found: DataFrame, recall: float = RECALL, made: int = MADE, share: int = SHARE, epochs: int = EPOCHS) -> Network | None:
    """Train on all different candidates, by what the network sees, and ``made`` findings of either label beside every share of them.

    The driver gets a row for every weight and a histogram of scores, whatever the number of candidates.
    """
    around = F.explode("cands").alias("c")
    seen = found.select(around).select(F.col("c.left").alias("left"), F.substring("c.body", 1, WIDTH).alias("body"), F.when(F.length("c.body") > WIDTH, F.substring("c.body", WIDTH + 1, RIGHT)).otherwise(F.col("c.right")).alias("right"), "c.labelled").distinct()
    seen = materialize(seen, "secrets-candidates")
    n = seen.count()
    if not n:
        return None
    shares = -(-n // share)
    dealt = seen.withColumn("share", F.pmod(F.xxhash64("left", "body", "right"), F.lit(shares))).repartition(shares, "share")
    if not made and seen.select("labelled").distinct().count() < 2:
        return None
    state = fresh_state()
    for epoch in range(epochs):
        state = _epoch(dealt, state, made, epoch)
    net, _ = network_of(state)

    def held(share: pa.Table) -> pa.Table:
        x, y = _rows_of(share, made)
        left, *_ = left_out(len(y))
        return pa.table({"place": places(net, x[left]), "label": y[left]})

    scores = dealt.groupBy("share").applyInArrow(held, "place long, label double").groupBy("place", "label").count().orderBy("place", "label").collect()
    return calibrated(net, *(np.array([r[c] for r in scores], float) for c in ("place", "label", "count")), recall)


def score(found: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, base, added: every candidate whose probability reaches the threshold, inside a finding of the rules or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 1024):
            every = batch.column("cands").to_pylist()
            asked = [(i, c) for i, own in enumerate(every) for c in own if net is not None]
            added: list[list[dict]] = [[] for _ in every]
            for k in range(0, len(asked), 2048):
                some = [(i, c, windows(c["left"], c["body"], c["right"])) for i, c in asked[k : k + 2048]]
                p = net.probability(np.stack([codes(*w) for *_, own in some for w in own]))
                at = 0
                for i, c, own in some:
                    if p[at : at + len(own)].max() >= net.threshold:
                        added[i].append({"kind": "network", "start": c["start"], "end": c["end"]})
                    at += len(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(added, pa.list_(_SPAN))], names=["doc_id", "base", "added"])

    return arrow_map(found, run, "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>")


def scan(docs: DataFrame, recall: float = RECALL, made: int = MADE) -> DataFrame:
    """doc_id, base, added for all documents: rules, and candidates that the trained network accepts."""
    found = materialize(find(docs), "secrets-found")
    return score(found, fit(found, recall, made))
