"""Comparisons of many runs in one pass, against the comparison of two."""

from __future__ import annotations

from visiquarry.operators import diff, trend

RUNS = [("a", 1, "completed", "h1"), ("a", 2, "failed", "h2"), ("a", 4, "completed", "h1"), ("a", 7, "completed", "h3"), ("b", 4, "completed", "h1"), ("b", 5, "running", "h1"), ("c", 1, "failed", "h1"), ("d", 1, "completed", None), ("d", 2, "completed", "h")]


def frames(spark):
    runs = spark.createDataFrame(RUNS, "client string, run_id int, status string, config_hash string")
    keywords = spark.createDataFrame(
        [("a", 1, "x", 3), ("a", 1, "y", None), ("a", 1, "z", 9), ("a", 2, "x", 1), ("a", 4, "x", 6), ("a", 4, "y", 2), ("a", 4, "w", None), ("a", 7, "x", 5), ("b", 4, "x", 1), ("d", 1, "x", 1), ("d", 2, "x", 1)],
        "client string, run_id int, keyword string, client_rank int")
    competitors = spark.createDataFrame([("a", 1, "p", True), ("a", 4, "p", False), ("a", 4, "q", True), ("a", 7, "q", True), ("a", 7, "p", True), ("d", 1, "q", True)], "client string, run_id int, domain string, is_real_competitor boolean")
    audits = spark.createDataFrame([("a", 1, "/", 1000.0, 10.0, 0.1), ("a", 4, "/", 1501.0, 5.0, 0.1), ("a", 7, "/", 2001.0, 5.0, None), ("a", 7, "/n", 1.0, 1.0, 1.0), ("d", 2, "/", 1.0, 1.0, 1.0)], "client string, run_id int, url string, lcp_ms double, inp_ms double, cls double")
    samples = spark.createDataFrame([("a", 1, "k", True), ("a", 1, "k", True), ("a", 4, "k", True), ("a", 4, "k", False), ("a", 7, "k", True), ("a", 7, "k", False), ("a", 7, "m", True)], "client string, run_id int, query string, client_mentioned boolean")
    pages = spark.createDataFrame([("a", 1, "/"), ("a", 1, "/2"), ("a", 4, "/"), ("a", 2, "/"), ("d", 2, "/")], "client string, run_id int, url string")
    found = spark.createDataFrame(
        [("a", 1, "c", "3 images", "/"), ("a", 4, "c", "2 images", "/"), ("a", 4, "c", "late", None), ("a", 4, "c", "late", None), ("a", 7, "c", "5 images", "/"), ("d", 1, "c", "x", "/")],
        "client string, run_id int, category string, title string, url string")
    return runs, keywords, competitors, audits, samples, pages, found


def test_changes_of_all_runs(spark):
    got = {(r.client, r.run_id, r.previous_run, r.kind, r.subject, r.previous_value, r.current_value, r.delta, r.severity) for r in trend.changes(*frames(spark)).collect()}
    want = {
        ("a", 4, 1, "rank_drop", "x", 3.0, 6.0, -3.0, "warning"), ("a", 4, 1, "rank_gained", "y", None, 2.0, 9.0, "info"), ("a", 4, 1, "rank_lost", "z", 9.0, None, -2.0, "warning"),
        ("a", 7, 4, "rank_change", "x", 6.0, 5.0, 1.0, None), ("a", 7, 4, "rank_lost", "y", 2.0, None, -9.0, "warning"),
        ("a", 4, 1, "competitor_exit", "p", None, None, None, None), ("a", 4, 1, "competitor_entry", "q", None, None, None, "info"), ("a", 7, 4, "competitor_entry", "p", None, None, None, "info"), ("d", 2, 1, "competitor_exit", "q", None, None, None, None),
        ("a", 4, 1, "vitals_lcp", "/", 1000.0, 1501.0, 501.0, "warning"), ("a", 4, 1, "vitals_inp", "/", 10.0, 5.0, -5.0, None), ("a", 4, 1, "vitals_cls", "/", 0.1, 0.1, 0.0, None),
        ("a", 7, 4, "vitals_lcp", "/", 1501.0, 2001.0, 500.0, None), ("a", 7, 4, "vitals_inp", "/", 5.0, 5.0, 0.0, None), ("a", 7, 4, "vitals_cls", "/", 0.1, None, None, None),
        ("a", 4, 1, "ai_rate", "k", 1.0, 0.5, -0.5, "warning"),
        ("a", 4, 1, "page_count", None, 2.0, 1.0, -1.0, None), ("a", 7, 4, "page_count", None, 1.0, 0.0, -1.0, None), ("d", 2, 1, "page_count", None, 0.0, 1.0, 1.0, None),
        ("a", 7, 4, "config_changed", None, None, None, None, "info"), ("d", 2, 1, "config_changed", None, None, None, None, "info"),
        ("a", 4, 1, "finding_new", "c|late|", 0.0, 2.0, 2.0, None), ("a", 7, 4, "finding_resolved", "c|late|", 2.0, 0.0, -2.0, None), ("d", 2, 1, "finding_resolved", "c|x|/", 1.0, 0.0, -1.0, None),
    }
    assert got == want


def test_equal_to_the_comparison_of_two(spark):
    runs, keywords, competitors, audits, samples, _, _ = frames(spark)
    compared = trend.comparisons(runs)
    of = lambda df, run: df.where(f"client = 'a' and run_id = {run}")
    for old, new in ((1, 4), (4, 7)):
        pair = {(r.keyword, r.previous_rank, r.current_rank, r.delta) for r in diff.rank_changes(of(keywords, old), of(keywords, new)).collect()}
        assert pair == {(r.subject, r.previous_value, r.current_value, r.delta) for r in of(trend.rank_changes(keywords, compared), new).collect()}
        pair = {(r.domain, f"competitor_{r.change}") for r in diff.entries_and_exits(of(competitors, old).where("is_real_competitor"), of(competitors, new).where("is_real_competitor")).collect()}
        assert pair == {(r.subject, r.kind) for r in of(trend.competitor_changes(competitors, compared), new).collect()}


def test_summaries_and_baselines(spark):
    given = frames(spark)
    got = {(r.client, r.run_id): r for r in trend.summary(given[0], trend.changes(*given)).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("a", 7), ("b", 4), ("d", 1), ("d", 2)}
    assert {k for k, r in got.items() if r.is_baseline} == {("a", 1), ("b", 4), ("d", 1)}
    assert not any(got["a", 1][c] for c in ("alerts", "rank_changes", "config_mismatch", "page_count_delta"))
    r = got["a", 4]
    assert (r.previous_run, r.config_mismatch, r.page_count_delta, r.rank_changes, r.alerts, r.new_findings) == (1, False, -1, 3, 6, 1)


def test_no_join_between_runs(spark):
    runs, keywords, *_ = frames(spark)
    plan = trend.rank_changes(keywords, trend.comparisons(runs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # facts with the table of runs


def test_summary_mart_computes_the_summaries_once(spark, sf_dir, monkeypatch):
    """Both publications read the stored rows, not the fact tables; the runs' states are read from a file of their own."""
    from visiquarry.plans import trend_queries

    read, publish = [], trend_queries.snapshots.publish_mart
    monkeypatch.setattr(trend_queries.snapshots, "publish_mart", lambda rows, *a: (read.append(rows.inputFiles()), publish(rows, *a)))
    assert trend_queries.summary_mart(spark, sf_dir).count() > 0
    assert len(read) == 2 and all("run-summaries-" in f for files in read for f in files)
    assert all("v_run_states-" in f for f in trend_queries.facts(spark, sf_dir)[0].inputFiles())
