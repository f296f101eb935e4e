"""Plan assertions: pruning, join strategies and skew-safe aggregation stay in place."""

from agrolens.plans.registry import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


def _plan(spark, name):
    df = REG[name].build(spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_lineitem_scan_is_pruned(spark):
    plan = _plan(spark, "rule_top3")
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "l_orderkey" in line]
    assert scans, plan
    for line in scans:
        cols = line.split("FileScan parquet [", 1)[1].split("]", 1)[0].split(",")
        assert len(cols) <= 6, line  # 11 columns in the table


def test_latest_price_uses_aggregate_not_window(spark):
    plan = _plan(spark, "latest_price")
    assert "Window [" not in plan and "WindowGroupLimit" not in plan
    assert any(a in plan for a in ("HashAggregate", "SortAggregate", "ObjectHashAggregate"))


def test_exact_median_counts_before_the_exchange(spark):
    plan = _plan(spark, "yield_median_by_crop")
    assert "rangepartitioning" not in plan and "partial_count" in plan


def test_samples_are_not_shuffled_on_crop(spark):
    plan = _plan(spark, "merge_median_yield")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_validation_does_not_expand_rows(spark):
    assert "Expand" not in _plan(spark, "validation_checks")


def test_only_pin_rows_meet_the_directory(spark):
    from pyspark.sql import functions as F

    from agrolens.operators import location
    rows = [(i, x) for i, x in enumerate(["", " ", "not a place", "560001", "999999", "12.9, 77.6"] * 20)]
    pins = spark.createDataFrame([("560001", 12.9, 77.6, "Karnataka", "Bengaluru", "GPO")], "pin string, lat double, lon double, state string, district string, place string")
    out = location.resolve_locations(spark.createDataFrame(rows, "location_id int, location string"), pins)
    assert out.groupBy("kind").count().orderBy("kind").collect()[0]["count"] == 20 and out.count() == 120
    assert out.where(F.col("error").isNull()).count() == 40
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join"):]
    assert "= pin)" in joined.split("Union")[0] or "pin" in joined


def test_join_small_beyond_its_limit_is_salted(spark):
    from agrolens.functions.joins import join_small
    large = spark.createDataFrame([(i, "hot" if i % 3 else "k" + str(i % 7)) for i in range(300)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, large.join(small, "k", how).select("i", "k", "v").collect()))
        for limit in (100, 2):
            assert sorted(map(str, join_small(large, small, "k", how, limit).select("i", "k", "v").collect())) == want


def test_export_scores_joins_are_broadcast(spark):
    plan = _plan(spark, "export_scores")
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
