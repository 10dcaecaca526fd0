"""Every registered query with SQL, against DuckDB over the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quillon.plans import load, registry

load()
SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(r) for r in df.select(*cols).collect())
    duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in duck.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert Counter(tuple(r[i] for i in order) for r in duck.fetchall()) == rows
