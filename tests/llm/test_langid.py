from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from visiquarry.llm import langid, queries


def test_held_out_accuracy(spark, sf_dir, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.QUERIES["op6_langid"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_blocks_do_not_change_counts(monkeypatch):
    features = langid.Features()
    text = "Größe, naïve! 12 ações \U00010400 " * 400
    whole = features.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 97)
    cut = features.counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_odd_and_empty_tables(spark, odd, empty):
    model = langid.fit(odd)
    rows = langid.predict(odd, model, ["doc_id", "key"]).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 6}
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(odd.withColumn("extra", F.lit(1)), model).columns[-2:] == ["lang_pred", "score"]


def test_partitions_do_not_matter(spark, docs):
    one, other = langid.fit(docs.coalesce(1)), langid.fit(docs.repartition(7, "text"))
    assert one.langs == other.langs and (one.weights == other.weights).all() and one.temperature == other.temperature


def test_weights_equal_plain_ftrl():
    """One coordinate at a time, in dictionaries."""
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(40, 6, replace=False)), r.random(6), int(r.integers(0, 3))) for _ in range(30)]
    got = langid.ftrl(rows, 3)
    z, n, order = {}, {}, np.random.default_rng(7)
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= langid.L1 else -np.sign(z[k]) * (abs(z[k]) - langid.L1) / ((langid.BETA + n[k] ** 0.5) / langid.ALPHA + langid.L2)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            columns, values, label = rows[i]
            w = {(c, k): weight((c, k)) for c in columns.tolist() for k in range(3)}
            logit = [sum(v * w[c, k] for c, v in zip(columns.tolist(), values)) for k in range(3)]
            p = np.exp(np.array(logit) - max(logit))
            p /= p.sum()
            for c, v in zip(columns.tolist(), values):
                for k in range(3):
                    g = v * (p[k] - (k == label))
                    have = n.get((c, k), 0.0)
                    z[c, k] = z.get((c, k), 0.0) + g - ((have + g * g) ** 0.5 - have**0.5) / langid.ALPHA * w[c, k]
                    n[c, k] = have + g * g
    assert all(abs(got[c, k] - weight((c, k))) < 1e-9 for c, k in z)


def test_temperature_is_inside_its_range():
    r = np.random.default_rng(5)
    labels = r.integers(0, 3, 4000)
    sure = np.eye(3)[labels] * 3 + r.gumbel(size=(4000, 3))
    own = langid.temperature(np.log(langid.softmax(np.eye(3)[np.argmax(sure, 1)] * 2.0)) * 50, labels)
    assert 1e-3 < own < 1e3 and abs(langid.temperature(np.eye(3)[labels] * 1e-2 + r.normal(0, 4e-3, (4000, 3)), labels)) < 0.05
