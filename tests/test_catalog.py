"""Every query of the catalog runs; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

from chronoloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _sorted(frame):
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    got, want = _sorted(catalog.queries()[name](spark, SF).toPandas()), _sorted(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


#: slow searches are tested by their parts
_LONG = {"entropy_penalty_search", "entropy_test_evaluation", "interval_summary", "spectrum_grid_search", "frobenius_grid_search"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL) - _LONG))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_grid_search_looks_at_all_windows(spark, duck, monkeypatch):
    """Signals of the search are those of window_entropy, and its SQL samples none."""
    from chronoloom.plans import pipelines

    seen = []
    search = pipelines.grid_search
    monkeypatch.setattr(pipelines, "grid_search", lambda signals, *rest, **more: seen.append(signals) or search(signals, *rest, **more))
    catalog.queries()["entropy_grid_search"](spark, SF)
    assert seen[0].count() == duck.execute(f"select count(*) from ({SQL['window_entropy']})").fetchone()[0]
    assert "ASOF" not in SQL["entropy_grid_search"]
