from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from visiquarry.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-_%+ 0123456789()é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.find_base(text) == plain(text)


def test_known_values():
    text = "4539 1488 0343 6467 x 256.1.1.1 10.0.0.255 +1 (523) 555-1055 a@b.c@d.e"
    assert pii.find_base(text) == plain(text)
    assert [k for k, *_ in pii.find_base(text)] == ["email", "ip", "card", "phone"]


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000):
        pii.find_base(text)


def test_disclosing_terms(spark):
    rows = [(i, f"call zorblax today {i} +49 30 1234567 ok") for i in range(6)] + [(100 + i, f"call someone ok today number {i}") for i in range(60)]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).where("size(terms) > 0").collect()
    assert {t["term"] for r in found for t in r["terms"]} == {"zorblax"}
    assert sorted(r["doc_id"] for r in found) == list(range(6))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[3] == "call  today 3 [PHONE] ok"
    assert clean[103] == "call someone ok today number 3"


def test_query_equals_patterns(spark, sf_dir, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.QUERIES["op2_pii"](spark, sf_dir).collect():
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{s}:{e}" for k, s, e in base}


def term_spans(rows, min_support=3, generalise_at=0.6, remove_at=0.9):
    """Terms of every text by plain counting over all pairs of entities and words."""
    word = re.compile(r"[^\W\d_]{3,}")
    n = len(rows)
    df, held, both, support = Counter(), Counter(), Counter(), defaultdict(set)
    own = {}
    for _, text in rows:
        text = text or ""
        base = plain(text)
        covered = {p for _, s, e in base for p in range(s, e)}
        places = defaultdict(list)
        for m in word.finditer(text):
            if not covered & set(range(*m.span())):
                places[m.group().lower()].append(m.span())
        df.update({m.lower() for m in word.findall(text)})
        entities = {k for k, *_ in base} | {(k, text[s:e].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])) for k, s, e in base}
        own[text] = entities, places
        held.update(entities)
        for e in entities:
            for t in places:
                both[e, t] += 1
                support[e, t].add(text)
    out = []
    for i, text in rows:
        entities, places = own[text or ""]
        got = {}
        for e in entities:
            for t in places:
                if len(support[e, t]) >= min_support and held[e] < n:
                    share = math.log2(n * both[e, t] / held[e] / df[t]) / math.log2(n / held[e])
                    if share >= generalise_at:
                        got[t] = max(got.get(t, ""), "remove" if share >= remove_at else "generalise")
        out.append((i, sorted((s, e, got[t], t) for t in got for s, e in places[t])))
    return sorted(out, key=str)


def spans_of(frame):
    return sorted(((r["doc_id"], [tuple(t) for t in r["terms"]]) for r in pii.detect(frame).collect()), key=str)


def test_term_spans_equal_brute_force(spark, docs, odd):
    want = term_spans([(r.doc_id, r.text) for r in docs.collect()])
    assert spans_of(docs) == want
    assert spans_of(odd) == term_spans([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    names = [f"name{c}" for c in "abc"]
    rows = [(i, f"{names[i % 3]} Zorblax wrote to a{i % 3}@b.example {'filler ' * (i % 5)}, then {'zorblax' if i % 2 else 'rested'}") for i in range(30)]
    rows = [(i, t.replace("namea", "anna").replace("nameb", "berta").replace("namec", "carla")) for i, t in rows] + [(100 + i, f"anna nothing here {'word ' * i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(frame) == term_spans(rows)
    assert any(terms for _, terms in spans_of(frame))


def test_terms_act_on_the_given_tables(spark, sf_dir):
    out = queries.QUERIES["op2_pii"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    assert out.where("n_terms > 0").count() > 0


def test_odd_and_empty_tables(odd, empty):
    assert pii.detect(odd).count() == odd.count()
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    assert out.count() == odd.count()
    assert out.where("text like '%[EMAIL]%'").count() == 2
    assert out.where("text is null").count() == 1
    assert pii.detect(empty).count() == 0
    assert pii.sanitise(empty).count() == 0
