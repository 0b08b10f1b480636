"""Plans that the queries are meant to have."""

import pytest

from panelwright.plans.explain import every_pair_joins, operators, scans
from panelwright.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_the_panel_reads_four_columns_of_the_line_items(spark):
    read = {place: columns for place, columns, _ in scans(QUERIES["src8_weekly_panel"](spark, SF))}
    assert len(read) == 4 and {c.split(":")[0] for c in read["lineitem.parquet"].split(",")} == {"l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"}


def test_filters_reach_the_scan(spark):
    ((_, columns, pushed),) = scans(QUERIES["so6_in_time_order"](spark, SF))
    assert "EqualTo(o_orderstatus,O)" in pushed and "o_totalprice" not in columns


@pytest.mark.parametrize("name", ["rg3_walk_forward", "ag6_metrics", "st4_sharpe_stats", "wn11_zscore_rank", "pr3_formation", "pr8_strategy_returns", "jn4_asof_forward", "rc5_fills", "rc3_orders", "fa14_nine", "st1_rotation_null"])
def test_no_join_without_an_equality(spark, name):
    assert every_pair_joins(QUERIES[name](spark, SF)) == 0


@pytest.mark.parametrize("name", ["rg3_walk_forward", "wn2_rolling", "fa1_momentum_value", "rg23_sweep"])
def test_no_python_where_expressions_do(spark, name):
    assert not [o for o in operators(QUERIES[name](spark, SF)) if "Python" in o or "Pandas" in o or "Arrow" in o]
