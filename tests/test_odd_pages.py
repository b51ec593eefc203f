"""Queries against their SQL on pages that the given tables lack: texts cut within an entity, and several pages with one URL."""

from __future__ import annotations

import os

import duckdb
import pytest

from visiquarry.plans.all_queries import ORACLES, QUERIES

ENTITIES = "a &amp b|&amp;lt|x &lt|y &gt;&gt|q &quot|o&#39|p&#39;1|c &copy|m &middot|&am|&amp;&amp".split("|")


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    """The smallest tables with 120 pages; every title and heading ends in an entity, every third page has the URL of another."""
    root = tmp_path_factory.mktemp("odd")
    for f in os.listdir(sf_dir):
        if f != "pages.parquet":
            os.symlink(os.path.join(sf_dir, f), root / f)
    db = duckdb.connect()
    db.sql("CREATE TABLE made (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for i in range(120):
        of = i - 1 if i % 3 == 2 else 0 if i == 60 else i
        end = ENTITIES[i % len(ENTITIES)]
        html = f'<!DOCTYPE html><html lang="en"><head><title>t{i % 5} {end}</title></head><body><h1>h{i % 7} {end}</h1><p>some words {i} {end}</p></body></html>'
        db.execute("INSERT INTO made VALUES (?, ?, ?)", [i, f"https://h{of % 4}.example.com/en/{of}", html])
    db.sql(f"COPY made TO '{root}/pages.parquet' (FORMAT parquet)")
    return str(root)


NAMES = (
    "extract_pages", "on_page_findings", "duplicate_findings", "duplicate_groups", "redirect_findings", "mark_synthetic", "link_findings", "crawlability_findings", "canonical_findings",
    "schema_findings", "page_keyword_match", "page_keyword_findings", "all_findings", "findings_by_url", "cap_findings",
)


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb_on_odd_pages(spark, odd, name):
    db = duckdb.connect()
    for f in os.listdir(odd):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{odd}/{f}'")
    frame = QUERIES[name](spark, odd)
    got = sorted(tuple(repr(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    want = db.sql(ORACLES[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got and got == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


def test_mentions_in_order_of_domain():
    """All three rivals in one answer; the operator names them in order of domain."""
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations AS SELECT 1::BIGINT AS conv_id, 1::BIGINT AS turn, 'assistant' AS role, 'thand ment erin' AS text")
    assert db.sql(f"SELECT competitors_mentioned FROM ({ORACLES['detect_mentions']})").fetchall() == [("erin.com,ment.com,thand.com",)]


def test_competitors_by_rate_not_by_rounded_rate():
    """s9.com is shown on one of 5,000,000 pages more than s27.com and s8.com: the same at six decimals, another place."""
    db = duckdb.connect()
    db.sql("CREATE TABLE part AS SELECT range AS p_partkey, 'p' AS p_name, 1 AS p_size FROM range(5000000)")
    db.sql("""CREATE TABLE lineitem AS SELECT range AS l_partkey, range AS l_orderkey, 1 AS l_linenumber, 1.0 AS l_extendedprice, DATE '2020-01-01' AS l_shipdate,
      CASE WHEN range < 1000 THEN 27 WHEN range < 2000 THEN 8 WHEN range < 3001 THEN 9 ELSE 0 END AS l_suppkey FROM range(5000000)""")
    rows = db.sql(ORACLES["competitor_map"]).fetchall()
    assert [r[0] for r in sorted(rows, key=lambda r: r[2])][:3] == ["s9.com", "s27.com", "s8.com"]
    assert len({r[1] for r in rows if r[2] in (1, 2, 3)}) == 1
