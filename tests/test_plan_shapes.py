"""What the plans look like: pushed filters, pruned columns, no nested loops, no full-group windows."""

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,fragment", [
    ("filter_basic", "GreaterThan(value,25.0)"),
    ("startpoint_timestamp", "GreaterThanOrEqual(ts,"),
    ("table_range", "LessThan(o_orderdate,"),
    ("sql_insert_select", "GreaterThan(o_totalprice,100000.0)"),
])
def test_filters_reach_the_scan(spark, data, name, fragment):
    text = plan(QUERIES[name](spark, data))
    assert "PushedFilters" in text and fragment in text


@pytest.mark.parametrize("name,columns", [
    ("tumbling_fold", "ts:timestamp_ntz,value:double"),
    ("sql_join_inner", "o_orderkey:bigint,o_custkey:bigint"),
])
def test_only_needed_columns_are_read(spark, data, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(QUERIES[name](spark, data))


@pytest.mark.parametrize("name", ["join_theta", "interval_join", "ttl_latest_join", "asof_table_join", "broadcast_fanout", "fan_out_route"])
def test_no_nested_loops(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_flat_operators_do_not_shuffle(spark, data):
    for name in ("map_project", "filter_basic", "scan_events", "fan_out_route", "merge_streams", "decode_json_props", "flat_map_async"):
        assert "Exchange" not in plan(QUERIES[name](spark, data)), name


def test_folds_combine_before_the_shuffle(spark, data):
    text = plan(QUERIES["keyed_tumbling_fold"](spark, data))
    assert text.count("HashAggregate") == 2 and "partial_sum" in text


def test_sliced_windows_partition_by_slice(spark, data):
    from tideloom.functions.times import millis
    from tideloom.operators.ordered import plan_slices, ranked
    from tideloom.session import table

    source = table(spark, data, "events").select("user_id", "event_id", millis("ts").alias("_ms"))
    slicing = plan_slices(source, "_ms", 200)
    text = plan(ranked(source, ["user_id"], ["_ms", "event_id"], "rn", slicing))
    windows = [line for line in text.splitlines() if "Window [" in line and "windowspec" in line]
    # rows are windowed per (key, slice); only the one-row-per-slice summaries are windowed per key
    assert len(windows) == 2
    assert "_slice" in windows[0].split("windowspecdefinition(")[1].split("_seed")[0]
    summaries = text.split("Window [")[2]
    assert "HashAggregate" in summaries and "partial_sum" in summaries
