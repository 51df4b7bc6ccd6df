"""Queries against their SQL twins on the small tables; PANEL_FULL=1 runs every query."""

from __future__ import annotations

import os

import pytest
from oracle import DATA, compare, database

from panelcraft.plans import catalog

SF = f"{DATA}/sf0.001"
QUICK = (
    "prj03_symbol_screen", "agg02_weekly_panel", "agg03_settled_events", "win09_liquid_universe", "jn01_asof_observations",
    "jn02_carried_grid", "val03_interval_mislabels", "win03_recursive_averages", "scr17_combinatorial_splits", "pnl06_option_trades",
    "pnl21_bond_returns", "src10_settled_pages", "str02_settled_stream", "agg04_price_frame", "jn03_venue_delta", "src01_funding_archives",
    "src07_two_sections", "src08_rate_years", "src12_content_fingerprint", "src13_file_audit", "scr12_headline_score", "scr22_tilt_family",
    "scr23_tilt_expense", "scr26_trend_gate", "top04_short_schedules",
)


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES) if os.environ.get("PANEL_FULL") else QUICK)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 140
