"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from voxmeter.plans import catalog

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def told(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    mine = [[told(r[c]) for c in sorted(df.columns)] for r in df.collect()]
    if name not in ORACLE:
        assert mine
        return
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    theirs = [[told(r[i]) for i in order] for r in cur.fetchall()]
    assert sorted(map(str, mine)) == sorted(map(str, theirs))


def test_layers_above_do_not_know_llm():
    root = Path(__file__).resolve().parents[1] / "voxmeter"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "voxmeter.llm" in p.read_text()]
