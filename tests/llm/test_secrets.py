from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from visiquarry.llm import queries, secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", " ", "=", ":", '"', "abcdef0123", "AKIA", "ABCDEFGH01234567", "0123456789abcdef01234567", "x", "é"]), max_size=12))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert secrets.find_base(text) == plain(text)


def test_network_learns_and_recalls(spark):
    r = np.random.default_rng(0)
    rand = lambda chars, n: "".join(r.choice(list(chars), n))
    rows = [(i, f"some text token = {rand('0123456789abcdef', 32)} and user{i}.name.is.plain{i % 10}.example") for i in range(400)]
    hidden = {1000 + i: rand("0123456789ABCDEF", 32) if i % 2 else rand("ABCDEFGHabcdefgh0123456789+/", 40) for i in range(60)}
    rows += [(i, f"nothing named here {value} end of it, ordinary-words and 2024-05-{10 + i % 20}") for i, value in hidden.items()]
    out = {x["doc_id"]: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    said = {i: [text[i][x["start"] : x["end"]] for x in out[i]["added"]] for i in text}
    assert sum(hidden[i] in said[i] for i in hidden) >= 0.9 * len(hidden)  # no rule sees these
    values = {i: text[i].split()[4] for i in range(400)}
    assert sum(values[i] in said[i] for i in values) >= 0.95 * len(values)
    assert sum(len(set(said[i]) - {values.get(i), hidden.get(i)}) for i in text) <= 25  # of 520 other candidates


def test_recall_and_false_alarms_on_findings_left_out():
    known, fresh = (secrets.made_findings(1200, [("the text ", " goes on")], seed) for seed in (1, 2))
    net = secrets.train(np.stack([secrets.codes(*x[:3]) for x in known]), np.array([float(x[3]) for x in known]))
    p, y = net.probability(np.stack([secrets.codes(*x[:3]) for x in fresh])), np.array([x[3] for x in fresh])
    assert (p[y] >= net.threshold).mean() >= 0.95
    assert (p[~y] >= net.threshold).mean() <= 0.1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", " ", "=", ": ", '"', "abcdef", "hunter", "AKIA", "ABCDEFGH01234567", "0123456789abcdef01234567", "x", "é", ".-."]), max_size=12))
def test_every_finding_of_the_rules_holds_a_candidate(parts):
    text = "".join(parts)
    own = secrets.candidates(text)
    for kind, s, e in secrets.find_base(text):
        lo = ASSIGN.match(text, s).start(1) if kind == "assign" else s
        assert any(a < e and lo < b for a, b in own)
        if kind == "assign":
            assert any(lo <= a and b == len(text[:e].rstrip(".-")) or (a, b) == (lo, e) for a, b in own)
    assert all(b - a >= 6 and set(text[a:b]) <= secrets._TOKENS for a, b in own)


def test_values_of_letters_are_candidates():
    for text, value in (("password = hunterxx", "hunterxx"), ("token = abcdefghijkl", "abcdefghijkl"), ('secret="abcdefgh"', "abcdefgh"), ("api_key='abcdef'", "abcdef"), ("my_token=abcdefgh; next", "abcdefgh"), ('name = "abcdefgh"', "abcdefgh"), ("aaaaaaaaaaaaaaaaaaaaaaaapassword=abcdef", "abcdef")):
        assert value in [text[a:b] for a, b in secrets.candidates(text)]
    assert secrets.candidates('username="ab"') == [] and secrets.candidates("plain words, all of them") == []


def test_windows_reach_the_end():
    for n in (6, 64, 65, 100, 112, 113, 500):
        body = "".join(chr(33 + i % 90) for i in range(n))
        parts = [w for _, w, _ in secrets.windows("left", body, "right")]
        assert body.startswith(parts[0]) and body.endswith(parts[-1]) and all(len(w) <= secrets.WIDTH for w in parts)
        assert len(parts) >= n / secrets.WIDTH


def test_query_equals_patterns(spark, sf_dir, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.QUERIES["op5_secrets"](spark, sf_dir).collect():
        base = plain(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in base) for x in secrets.KINDS)
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{s}:{e}" for k, s, e in base}


def test_odd_and_empty_tables(odd, empty):
    assert secrets.scan(odd).count() == odd.count()
    assert secrets.scan(empty).count() == 0


def test_network_acts_on_the_given_tables(spark, sf_dir):
    out = queries.QUERIES["op5_secrets"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    assert out.where("n_network > 0").count() > 0


def test_every_candidate_takes_part_in_training(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, f"x{i} token = {''.join(r.choice(list('0123456789abcdef'), 32))} and user{i}.name.is.plain{i % 10}.example") for i in range(300)]
    found = secrets.find(spark.createDataFrame(rows, "doc_id long, text string"))
    seen, epoch = [], secrets._epoch
    monkeypatch.setattr(secrets, "_epoch", lambda dealt, *more: seen.append(dealt) or epoch(dealt, *more))
    nets = [secrets.fit(found, made=40, share=200, epochs=2) for _ in range(2)]
    assert seen[0].count() == 600 and seen[0].select("share").distinct().count() == 3
    assert nets[0].threshold == nets[1].threshold and np.array_equal(nets[0].kernel, nets[1].kernel)
