"""Percentiles of the stream: counts by value, versions of buckets, replays, late and repeated beacons."""

from __future__ import annotations

import glob
import json
import random

from pyspark.sql import functions as F

from visiquarry.streaming import rum

SAMPLE = "client string, url string, metric string, value double, seq long, attribution string"


def sample_rows(n, seed, urls=12):
    r = random.Random(seed)
    return [("c", f"https://a.com/{int(r.random() ** 3 * urls)}", r.choice(rum.METRICS), float(r.choice([0, 1, 5, r.randrange(3000), round(r.random() * 4000, 3)])), seed * 100_000 + i, f"a{i}") for i in range(n)]


def rows_of(df):
    return {(r.client, r.url, r.metric): (r.n, r.value) for r in df.collect()}


def test_counts_give_the_exact_rank(spark):
    frame = spark.createDataFrame(sample_rows(3000, 1) + [("c", "big", "LCP", 1e300, 0, ""), *[("c", "big", "LCP", float(v), v, "") for v in (0, 0, 0, 0)], *[("c", "few", "LCP", 1.0, i, "") for i in range(4)]], SAMPLE)
    want = rows_of(rum.p75(frame))
    got = rows_of(rum.p75_of_counts(rum.merged_counts(rum.value_counts(frame))))
    assert got == want and ("c", "few", "LCP") not in got and got["c", "big", "LCP"] == (5, 0.0)


def test_batches_touch_their_own_buckets(spark, tmp_path):
    root, every = f"file://{tmp_path}", []
    parts = [sample_rows(400, 2), sample_rows(50, 3, 2), [("c", "https://a.com/late", "LCP", float(v), v, "") for v in range(9)], []]
    for number, part in enumerate(parts):
        every += part
        spark.createDataFrame(part, SAMPLE).write.parquet(f"{root}/samples/batch={number}")
        rum.add_batch(spark, root, number)
        assert rows_of(rum.current_p75(spark, root, number)) == rows_of(rum.p75(spark.createDataFrame(every, SAMPLE)))
    written = [len(glob.glob(f"{tmp_path}/counts/batch={n}/bucket=*")) for n in range(4)]
    assert written[0] > 15 and written[1] <= 8 and written[2:] == [1, 0]
    # a batch that runs again gives the same, and a reader of an earlier one still sees it
    before = rows_of(rum.current_p75(spark, root, 3))
    rum.add_batch(spark, root, 2)
    rum.add_batch(spark, root, 3)
    assert rows_of(rum.current_p75(spark, root, 3)) == before
    assert rows_of(rum.current_p75(spark, root, 0)) == rows_of(rum.p75(spark.createDataFrame(parts[0], SAMPLE)))


def test_a_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    root, rows = f"file://{tmp_path}", [sample_rows(100, 4, 2), sample_rows(100, 5, 2)]
    for number in (0, 1):
        spark.createDataFrame(rows[number], SAMPLE).write.parquet(f"{root}/samples/batch={number}")
    rum.add_batch(spark, root, 0)
    before = rows_of(rum.current_p75(spark, root, 0))

    def fail(counts):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rum, "p75_of_counts", fail)
        try:
            rum.add_batch(spark, root, 1)
            raise AssertionError("it went through")
        except RuntimeError:
            pass
    assert rows_of(rum.current_p75(spark, root, 0)) == before
    rum.add_batch(spark, root, 1)
    assert rows_of(rum.current_p75(spark, root, 1)) == rows_of(rum.p75(spark.createDataFrame(rows[0] + rows[1], SAMPLE)))


def test_stream_counts_a_repeated_beacon_once(spark, tmp_path):
    root, r = f"file://{tmp_path}", random.Random(6)
    good = lambda v: {"url": "https://a.com/", "metric": "LCP", "value": v, "rating": "good"}
    beacons = [(f"b{i}", "2026-01-01 00:00:00", json.dumps([good(float(r.randrange(5000))), good(float(i))])) for i in range(20)]
    late = [("late", "2026-01-01 00:10:00", json.dumps([good(9000.0)] * 30)), ("bad", "2026-01-01 00:10:00", "[]")]
    for k, part in enumerate((beacons[:12], beacons[6:], beacons[:3] + late)):  # sent again in later files
        schema = "beacon string, sent string, payload string"
        frame = spark.createDataFrame(part, schema).select("beacon", F.to_timestamp("sent").alias("sent"), "payload", F.lit("c").alias("client"), F.lit("https://a.com").alias("origin"))
        frame.coalesce(1).write.json(f"{root}/landed/part={k}")
    schema = "client string, origin string, payload string, beacon string, sent timestamp"
    stream = rum.start(spark, f"{root}/landed/*", root, schema, files_per_batch=1, beacon_id="beacon", sent_at="sent")
    stream.awaitTermination()
    once = [s for b in [*beacons, late[0]] for s in json.loads(b[2])]
    want = rows_of(rum.p75(spark.createDataFrame([("c", s["url"], s["metric"], s["value"], i, "") for i, s in enumerate(once)], SAMPLE)))
    assert rows_of(rum.current_p75(spark, root, rum.last_batch(stream))) == want
    assert spark.read.parquet(f"{root}/rejects").count() == 1
