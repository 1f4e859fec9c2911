"""Registered queries against their SQL twins on the smallest data."""

import duckdb
import pytest

from check import TABLES, norm
from tapewell.operators import features as ft
from tapewell.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()
SAMPLE = (
    "a35_backtest_summary", "s01_flat_file_bars", "k01_bar_upsert", "p01_validate_records", "w13_pair_correlation", "j02_asof_fundamentals", "w24_ownership_delta",
    "fs_options_surface_v1", "t03_turnover_cap", "a29_regime_slices", "r01_stream_bars", "r07_stream_kill_switch", "j15_sweep_expansion",
)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert len(catalog.QUERIES) > 180


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = con.execute(catalog.ORACLES[name])
    idx = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got


@pytest.mark.parametrize("name", ["core_v1_xsec_regime_opts_v1", "core_v1_xsec_regime_opts_v1_lag1", "core_v1_fundamentals_regime_xsec_v1"])
def test_regime_columns_of_feature_sets(spark, name):
    assert set(ft.REGIME_COLUMNS) <= set(catalog.QUERIES[f"fs_{name}"](spark, SF).columns)
    assert all(f'AS "{c}"' in catalog.ORACLES[f"fs_{name}"] for c in ft.REGIME_COLUMNS)
