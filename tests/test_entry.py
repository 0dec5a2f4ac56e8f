"""The driver contract, with the optional subpackage and without it."""

from __future__ import annotations

import glob
import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from grainmill import queries as core

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_optional_subpackage():
    code = "import sys; sys.modules['grainmill.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1]); assert 'quality_curate' in e.queries() and not any(k.startswith('op1') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_outside_imports_it():
    for path in (ROOT / "grainmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "grainmill.llm" not in path.read_text(), path


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    def value(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v

    return sorted(repr([value(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    got = core.QUERIES[name](spark, DATA)
    want = tables.execute(core.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_payloads_have_the_whole_text(spark):
    """Every part of a text stands in its payload, in order."""
    from grainmill import lexicons as L
    from grainmill import queries_reports as reports

    for r in reports._rows(spark, DATA).collect():
        fields = json.loads(r["answer"])[L.TOP_KEY]
        assert "".join(fields[f] for f in L.REPORT_FIELDS) == r["completion"]
