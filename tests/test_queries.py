"""Every registered query that has SQL against DuckDB, and the others for rows and schema."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from visiquarry.plans.all_queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    got = sorted(tuple(repr(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(frame.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage():
    """A fresh interpreter in which the subpackage and the pipeline can't be imported still registers the other queries."""
    code = (
        "import sys; sys.modules['visiquarry.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); print(len(names), 'pipeline' in names, any(n.startswith('op') and n[2].isdigit() for n in names))"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(QUERIES)), "False", "False"]


@pytest.mark.parametrize(("name", "most"), [("canonical_findings", 0), ("redirect_findings", 0), ("link_findings", 0), ("duplicate_findings", 0), ("crawlability_findings", 0), ("on_page_findings", 1)])
def test_html_is_parsed_once(spark, sf_dir, name, most):
    """Pages that several rules read are parsed before the query's own plan; rules without HTML never parse."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= most
