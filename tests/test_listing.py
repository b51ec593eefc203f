"""The listing of findings under their URLs."""

from __future__ import annotations

from visiquarry.operators import findings

SCHEMA = "client string, run_id int, seq int, url string, rule string, category string, severity string, title string, evidence string, impact int, phase_share double"


def _finding(seq, url, severity, share=None, client="c"):
    return (client, 1, seq, url, f"r{seq}", "onpage", severity, f"t{seq}", f"e{seq}", findings.IMPACT[severity], share)


def test_every_finding_stands_under_its_url(spark):
    made = [
        _finding(1, "/a", "low"), _finding(2, "/a", "critical"), _finding(3, "/a", "high", 0.2), _finding(4, "/a", "high", 0.6), _finding(5, "/a", "low"),
        _finding(6, "/b", "medium"), _finding(7, None, "medium"), _finding(8, None, "high"), _finding(9, "/a", "low", client="d"),
    ]
    rows = findings.by_url(spark.createDataFrame(made, SCHEMA)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault((r.client, r.url, r.n_findings, r.impact, r.worst), []).append((r.place, r.title, r.evidence, r.own_impact))
    assert got == {
        ("c", "/a", 5, 70, 1): [(1, "t2", "e2", 70), (2, "t4", "e4", 45), (3, "t3", "e3", 45), (4, "t1", "e1", 10), (5, "t5", "e5", 10)],
        ("c", "/b", 1, 25, 3): [(1, "t6", "e6", 25)],
        ("c", None, 2, 45, 2): [(1, "t8", "e8", 45), (2, "t7", "e7", 25)],
        ("d", "/a", 1, 10, 4): [(1, "t9", "e9", 10)],
    }


def test_listing_of_many_findings_without_url(spark):
    """More findings than a block of places; each has its place once and meets the totals once."""
    n = 2 * findings.BLOCK + 5
    rows = findings.by_url(spark.createDataFrame([_finding(i, None, "medium") for i in range(n)], SCHEMA).repartition(5)).collect()
    assert sorted((r.place, r.seq) for r in rows) == [(i + 1, i) for i in range(n)] and {(r.n_findings, r.impact, r.worst) for r in rows} == {(n, 25, 3)}
