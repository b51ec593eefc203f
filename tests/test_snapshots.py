"""Commits of snapshot tables: failed, repeated, conflicting and replaced writes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from visiquarry.operators import snapshots
from visiquarry.operators.runs import NATURAL_KEYS

SCHEMA = "client string, run_id int, domain string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def seen(spark, root, **of):
    return sorted((r.client, r.run_id, r.domain, r.n) for r in snapshots.read(spark, root, "competitors", **of).collect())


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def test_append_and_read(spark, root):
    assert snapshots.commit(rows(spark, ("c", 1, "a.com", 2), ("c", 2, "a.com", 3), ("001", 1, "a.com", 4)), root, "competitors", "one")
    assert snapshots.commit(rows(spark, ("c", 1, "b.com", 5)), root, "competitors", "two")
    want = [("001", 1, "a.com", 4), ("c", 1, "a.com", 2), ("c", 1, "b.com", 5), ("c", 2, "a.com", 3)]
    assert seen(spark, root) == want and seen(spark, root, client="c", run_id=1) == want[1:3] and seen(spark, root, client="c") == want[1:]
    assert seen(spark, root, client="x", run_id=1) == []
    plan = snapshots.read(spark, root, "competitors", "c", 2).inputFiles()
    assert len(plan) == 1 and "commit=one/client=c/run_id=2" in plan[0]


def test_clients_that_look_like_numbers(spark, root):
    snapshots.commit(rows(spark, ("001", 1, "a.com", 2), ("1", 2, "a.com", 3)), root, "competitors", "7")
    assert seen(spark, root) == [("001", 1, "a.com", 2), ("1", 2, "a.com", 3)] and seen(spark, root, client="001", run_id=1) == [("001", 1, "a.com", 2)]


def test_a_repeated_commit_is_known(spark, root):
    given = rows(spark, ("c", 1, "a.com", 2))
    assert snapshots.commit(given, root, "competitors", "one") and not snapshots.commit(given, root, "competitors", "one")
    assert seen(spark, root) == [("c", 1, "a.com", 2)]


@pytest.mark.parametrize("bad", [[("c", 1, "b.com", 1), ("c", 1, "b.com", 2)], [("c", 1, "a.com", 9)], [("d", 1, "x.com", 1), ("c", 1, "a.com", 9)]])
def test_conflicts_leave_the_table(spark, root, bad):
    snapshots.commit(rows(spark, ("c", 1, "a.com", 2)), root, "competitors", "one")
    with pytest.raises(snapshots.KeyConflict):
        snapshots.commit(rows(spark, *bad), root, "competitors", "two")
    assert seen(spark, root) == [("c", 1, "a.com", 2)]
    # the name was not used up, and the same keys fit another run
    assert snapshots.commit(rows(spark, ("c", 2, "a.com", 9)), root, "competitors", "two")
    assert seen(spark, root) == [("c", 1, "a.com", 2), ("c", 2, "a.com", 9)]


def test_a_failed_write_leaves_the_table(spark, root, monkeypatch):
    snapshots.commit(rows(spark, ("c", 1, "a.com", 2)), root, "competitors", "one")
    broken = rows(spark, ("c", 2, "a.com", 1), ("c", 3, "a.com", 0)).withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        snapshots.commit(broken, root, "competitors", "two")
    with monkeypatch.context() as m:  # after the data and before the manifest
        m.setattr(snapshots, "_repeated", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            snapshots.commit(rows(spark, ("c", 2, "a.com", 7), ("c", 4, "a.com", 7)), root, "competitors", "two")
    assert seen(spark, root) == [("c", 1, "a.com", 2)]
    assert snapshots.commit(rows(spark, ("c", 2, "a.com", 1)), root, "competitors", "two")
    assert seen(spark, root) == [("c", 1, "a.com", 2), ("c", 2, "a.com", 1)]


def test_marts_replace_their_runs(spark, root):
    mart = lambda name, *values: snapshots.publish_mart(rows(spark, *values), root, "top", name)
    mart("one", ("c", 1, "a.com", 1), ("c", 1, "a.com", 1), ("c", 2, "a.com", 1))
    mart("two", ("c", 2, "b.com", 2), ("c", 3, "b.com", 2))
    assert sorted((r.run_id, r.domain) for r in snapshots.read(spark, root, "mart_top").collect()) == [(1, "a.com"), (1, "a.com"), (2, "b.com"), (3, "b.com")]


def test_retention_drops_old_runs(spark, root):
    snapshots.commit(rows(spark, *[("c", i, "a.com", i) for i in range(1, 6)], ("d", 1, "a.com", 1)), root, "competitors", "one")
    runs = spark.createDataFrame([("c", i) for i in range(1, 7)] + [("d", 1)], "client string, run_id int")
    assert snapshots.retire(runs, root, "competitors", "old", 3) and not snapshots.retire(runs, root, "competitors", "old", 3)
    assert seen(spark, root) == [("c", 4, "a.com", 4), ("c", 5, "a.com", 5), ("d", 1, "a.com", 1)]
    # a run that was dropped can be written again
    assert snapshots.commit(rows(spark, ("c", 1, "a.com", 8)), root, "competitors", "again")
    assert seen(spark, root)[0] == ("c", 1, "a.com", 8)


def test_every_fact_table_has_keys():
    assert len(NATURAL_KEYS) == 13
