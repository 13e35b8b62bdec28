"""Plan shapes that must hold whatever the data size."""

from datetime import datetime

import pytest

from tallyloom.operators import filters
from tallyloom.plans.catalog import QUERIES
from tallyloom.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "full_analysis", "boxplot", "histogram_norm", "kde", "share", "filter_top_n", "scale_bucket", "flag_rules", "lookup_exact", "lookup_asof",
    "lookup_nearest", "moving_average", "running_total", "spatial_intersects", "dedupe_papers", "merge_papers", "pivot_show_as", "doc_compare"])
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_date_group_reaches_the_scan(spark):
    text = plan(filters.filter_date_group(table(spark, FOLDER, "events"), "ts", datetime(2024, 1, 15), "day").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["doc_sections", "doc_classify", "doc_quality", "cite_resolve", "text_quality"])
def test_text_is_not_shuffled_by_key(spark, name):
    assert "hashpartitioning" not in plan(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["reading_order", "table_regions"])
def test_pages_are_read_once(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert text.split("== Initial Plan ==")[-1].count("FileScan") == 1 and "Join" not in text


def test_heading_infer_finds_the_first_line_without_a_window_over_lines(spark):
    text = plan(QUERIES["heading_infer"](spark, FOLDER))
    assert "row_number" not in text
