"""Every query against its SQL over the small tables, and the driver's contract."""

import math
import numbers
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from foliospark.plans import oracle, queries
from foliospark.sources.staging import remove, shared_dir

from .conftest import DATA


def canonical(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, numbers.Integral):
            return int(x)
        if isinstance(x, float):
            return float(f"{x:.12g}")
        return str(list(x)) if hasattr(x, "tolist") or isinstance(x, list) else str(x)

    rows = [tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in oracle.SQL])
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in oracle.SQL])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 5
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["deck_files", "lesson_files"])
def test_office_files_go_round_by_round(spark, duck, monkeypatch, name):
    """Few files stand on disk at once, every one is read, and none is left."""
    written = []
    monkeypatch.setattr(queries, "remove", lambda s, path: (written.append(len(list(Path(path.removeprefix("file://")).glob("*.*")))), remove(s, path)), raising=False)
    kept = set(Path(shared_dir(spark).removeprefix("file://")).glob("office-*"))
    monkeypatch.setattr(queries, "TASK_FILES", 50, raising=False)
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert canonical(got) == canonical(duck.execute(oracle.SQL[name]).df())
    assert set(Path(shared_dir(spark).removeprefix("file://")).glob("office-*")) <= kept
    assert sum(n for n in written if n) == len(got) and len(written) > 1 and max(written) < len(got)


def test_each_task_has_its_own_folder_of_office_files(spark, monkeypatch):
    """Tasks that make files in one folder wait for each other."""
    written = []
    monkeypatch.setattr(queries, "remove", lambda s, path: (written.append(len(list(Path(path.removeprefix("file://")).glob("*.*")))), remove(s, path)))
    monkeypatch.setattr(queries, "TASK_FILES", 200)
    assert queries.deck_files(spark, DATA).count() == sum(written) and max(written) <= 200


def test_outlines_deal_narrow_rows(spark):
    """Line items are dealt as they are, not as the texts made of them."""
    plan = queries._outlines(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_COL" in exchanges[0]
