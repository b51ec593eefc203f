"""Queries on pages whose texts are longer than the given tables': all of a text counts, and the SQL says the same."""

from __future__ import annotations

import hashlib
import os

import duckdb
import pytest

from visiquarry.plans.all_queries import ORACLES, QUERIES
from visiquarry.sources.html_pages import parse_page


def _long(i: int) -> str:
    """25,000 characters in one word, in many, or in none, then words that stand nowhere before."""
    return ("x" * 25_000, "lorem ipsum " * 2_100, "")[i % 3] + f" then {'more ' * 200}Own Name {i} ends"


@pytest.fixture(scope="module")
def long(sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("long")
    for f in os.listdir(sf_dir):
        if f != "pages.parquet":
            os.symlink(os.path.join(sf_dir, f), root / f)
    db = duckdb.connect()
    db.sql("CREATE TABLE made (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for i in range(48):
        html = f'<!DOCTYPE html><html lang="en"><head><title>Own Name {i}</title></head><body><p>{_long(i)}</p></body></html>'
        db.execute("INSERT INTO made VALUES (?, ?, ?)", [i, f"https://h{i % 4}.example.com/en/{i}", html])
    db.sql(f"COPY made TO '{root}/pages.parquet' (FORMAT parquet)")
    return str(root)


def _rows(spark, folder, name):
    """The query's rows as dicts, once they are the rows of its SQL."""
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    frame = QUERIES[name](spark, folder)
    rows = [r.asDict() for r in frame.collect()]
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(frame.columns)
    told = [dict(zip(want.columns, r)) for r in want.fetchall()]
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    assert rows and sorted(map(key, rows)) == sorted(map(key, told))
    return rows


def test_page_is_read_to_its_end():
    assert parse_page(f"<body>{_long(0)}</body>", None)["body_text"].endswith("Own Name 0 ends")


def test_words_and_digest_of_whole_texts(spark, long):
    got = {r["page_id"]: (r["word_count"], r["body_md5"]) for r in _rows(spark, long, "extract_pages")}
    whole = {i: " ".join(_long(i).split()) for i in range(48)}
    assert got == {i: (len(text.split(" ")), hashlib.md5(text.encode()).hexdigest()) for i, text in whole.items()}


def test_keywords_at_the_end_of_long_texts(spark, long):
    """Every fourth page's keyword is its title, which its text names at the end. Page 40 is met by the redirect of page 39, whose text does not."""
    rows = _rows(spark, long, "page_keyword_findings")
    assert {r["evidence"] for r in rows if r["rule"] == "keyword_not_in_body" and r["evidence"].startswith("Own Name")} == {"Own Name 40"}


def test_listing_judges_whole_texts(spark, long):
    """A page of one long word and 204 others is not thin; every finding of a page stands under its URL, gravest first."""
    rows = _rows(spark, long, "findings_by_url")
    own = {f"https://h{i % 4}.example.com/en/{i}" for i in range(48)}
    mine = [r for r in rows if r["url"] in own]
    assert len(mine) > 48 and not [r for r in mine if r["rule"] == "thin_content"]


@pytest.mark.parametrize("name", ["on_page_findings", "page_keyword_match", "single_page_check", "findings_diff", "cap_findings", "all_findings"])
def test_other_queries_equal_their_sql(spark, long, name):
    assert _rows(spark, long, name)
