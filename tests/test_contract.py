"""The driver contract, and some registered queries beside their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridseries.catalog import all_queries
from tools.check_queries import rows_of

QUICK = [
    "quantiles_hourly",
    "merge_duplicates",
    "detect_zeros",
    "runs",
    "repair_interpolate",
    "regrid",
    "interpolate_limited",
    "lag_features",
    "prev_day_mean",
    "one_hot",
    "scale_minmax",
    "cv_splits",
    "rolling_mean",
    "availability_pct",
    "nearest_place_join",
    "radius_neighbours",
    "arch_summary",
    "sweep_pivot",
    "scan_ny_load",
    "scan_csv_paths",
    "write_by_zone",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = set(all_queries())
    assert own == set(entry.oracle_sql()) & own


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["day", "MAPE"] and out.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())
