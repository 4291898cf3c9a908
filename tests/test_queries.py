"""Every registered query with SQL gives the rows that SQL gives; the others give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cuelake.plans import queries as plans


def _cell(v):
    if v is None or v != v:
        return "-"
    return repr(v) if isinstance(v, float) else str(v)


def _rows(cols, names, rows):
    at = [names.index(c) for c in cols]
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, tiny, duck, name):
    df = plans.queries()[name](spark, tiny)
    rel = duck.sql(plans.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert _rows(cols, df.columns, df.collect()) == _rows(cols, rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_gives_rows(spark, tiny, name):
    assert plans.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_window_chain_shuffles_once(spark, tiny):
    from cuelake.cues import read_cue_view
    from cuelake.operators import windows

    chain = windows.with_rhythm(windows.close_gaps(read_cue_view(spark, tiny)))
    assert chain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
