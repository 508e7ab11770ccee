"""Physical-plan properties that matter at scale (checked on sf0.001)."""

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

QUERIES = entry.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_single_partition_exchange(spark):
    plan = _plan(QUERIES["city_rankings"](spark, SF_SMALL))
    # an un-partitioned window would need Exchange SinglePartition
    assert "SinglePartition" not in plan


def test_spatial_join_is_not_a_nested_loop(spark):
    plan = _plan(QUERIES["spatial_assignment"](spark, SF_SMALL))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_year_filter_prunes_crash_partitions(spark):
    plan = _plan(QUERIES["export_crash_points"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan and ">= 2001" in plan


def test_checks_read_only_needed_columns(spark):
    plan = _plan(QUERIES["missing_fields"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("lon" not in s and "road_label" not in s for s in scans)


def test_raw_scan_keeps_expressions_in_codegen(spark):
    # the normalisation is native: no Python UDF evaluation in the plan
    plan = _plan(QUERIES["raw_crash_load"](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_ten_year_window_prunes_partitions(spark):
    plan = _plan(QUERIES["city_stats"](spark, SF_SMALL))
    filters = [line.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
               for line in plan.splitlines() if "PartitionFilters: [" in line]
    assert any("year" in f and " IN (" in f for f in filters)


def test_spatial_join_reads_the_points_once(spark):
    plan = _plan(QUERIES["spatial_assignment"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert len(scans) == 1
