"""Plans stay what they should be: filters and columns reach the scan, no product joins."""

import os
import re

import pytest

import __spark_entry__
from ledgerlake.plans import measures, problems, quality, relational

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

#: Queries that attach a table of one row.
ONE_ROW = {"b14_forecast_cagr", "s15_object_checks", "b6_kpi_texts", "j07_scalar_cross", "a15_scalars_as_columns", "b3_revenue_yoy", "b6_kpi_latest", "b9_ratio_delta", "b13_cohort_lines", "q15_forecast_scorecard", "q6_forecast_checks", "q7_completeness", "q19_sign_off"} | {n for n in quality.QUERIES if n.startswith("q3_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted({**relational.QUERIES, **problems.QUERIES, **measures.QUERIES}))
def test_no_product_joins(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text
    if name not in ONE_ROW:
        assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(relational.QUERIES["pred02_in_list"](spark, DATA))
    assert re.search(r"PushedFilters: \[In\(p_size", text) and "p_name" not in re.search(r"ReadSchema: (.*)", text)[1]
    text = plan(relational.QUERIES["pred03_fy_or_null"](spark, DATA))
    assert "PushedFilters: [Or(" in text and "hashdiff" not in text
    for name in ("p1_found", "p2_found"):
        assert "record_source" not in plan(problems.QUERIES[name](spark, DATA))


def test_partitions_are_pruned(spark):
    assert re.search(r"PartitionFilters: \[.*filed_year", plan(relational.QUERIES["s6_partition_pruning"](spark, DATA)))


def test_aggregations_combine_before_the_shuffle(spark):
    text = plan(problems.QUERIES["p2_found"](spark, DATA))
    assert "partial_max" in text
    assert "partial_count" in plan(relational.QUERIES["a09_rollup_total"](spark, DATA))


def test_visibility_is_no_join(spark):
    text = plan(relational.QUERIES["pred08_visibility"](spark, DATA))
    assert "Join" not in text and "Exchange" not in text and "Generate explode" in text


def test_dates_are_expanded_last(spark):
    from ledgerlake.plans.warehouse import Build

    build = Build(spark, DATA)
    for df in (build.panel_rows(), build.pit, build.bridge):
        text = plan(df)
        above = text[: text.index("Generate explode")]
        assert "Exchange" not in above and "Join" not in above


def test_sectors_are_not_forced_to_broadcast(spark):
    from ledgerlake.plans.warehouse import Build

    assert "ResolvedHint" not in Build(spark, DATA).peer_benchmark._jdf.queryExecution().logical().toString()
