"""The registered queries against their SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

from foliospark.llm import queries

from ..conftest import DATA
from ..test_queries import canonical


@pytest.mark.parametrize("name", queries.SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
