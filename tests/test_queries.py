"""Some registered queries against their SQL at the smallest scale; the driver compares all of them."""

import os

import duckdb
import pytest

from charlspark.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["dx_long", "gold_score", "freq_by_age", "s1_interval", "s2_expected_by_age", "s3_mi", "s4_median"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DIR), con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_names():
    assert set(registry.oracle_sql()) == set(registry.queries())
