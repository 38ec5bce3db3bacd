"""A few registered queries against their SQL on the smallest fixtures; the driver runs them all."""

import os

import duckdb
import pytest

from foldlens.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures are absent")


@pytest.mark.parametrize("name", ["wga_sensitivity", "overall_metrics", "ovr_auc", "eod_legacy_zero", "validation_split", "crosstab_axes", "connected_components"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    plain = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from want").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
