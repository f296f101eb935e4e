"""The distributed exact percentile equals numpy's linear interpolation, also under skew."""

import numpy as np
from pyspark.sql import functions as F

from agrolens.functions.percentiles import exact_percentiles


def test_exact_percentiles_skewed(spark):
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(5000) < 0.6, "hot", rng.choice(["a", "b", "c"], 5000))
    vals = rng.normal(100, 30, 5000).round(2)
    df = spark.createDataFrame([(str(k), float(v)) for k, v in zip(keys, vals)], "k string, v double")
    out = {r.k: r for r in exact_percentiles(df, ["k"], "v", [0.5, 0.95]).collect()}
    for k in set(keys):
        sel = vals[keys == k]
        assert out[k].n == len(sel)
        assert abs(out[k].p50 - np.percentile(sel, 50)) < 1e-9
        assert abs(out[k].p95 - np.percentile(sel, 95)) < 1e-9


def test_exact_percentiles_global(spark):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("v"))
    r = exact_percentiles(df, [], "v", [0.5, 0.99]).first()
    assert r.p50 == 51.0 and abs(r.p99 - 100.0) < 1e-9


def test_exact_percentiles_without_exchange_reuse(spark):
    """Two evaluations of the same frame must agree by the data alone."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(2_000_000).select((F.xxhash64("id") % 100_000_000).cast("double").alias("v"))
        want = df.agg(F.expr("percentile(v, array(0.5, 0.99))").alias("p")).first().p
        got = exact_percentiles(df, [], "v", [0.5, 0.99]).first()
        assert [got.p50, got.p99] == want and got.n == 2_000_000
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_hot_value_combines_before_the_exchange(spark):
    """A value that 90 percent of the rows share reaches the exchange as one row a task."""
    df = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = exact_percentiles(df, [], "v", [0.5, 0.95]).first()
    assert r.p50 == 0.0 and r.p95 == np.percentile(np.where(np.arange(200_000) % 10 > 0, 0.0, np.arange(200_000.0)), 95)
    counts = df.groupBy("v").count()
    assert counts.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count") / F.avg("count")).first()[0] < 2


def test_ordered_bucket_is_monotone(spark):
    from agrolens.functions.percentiles import ordered_bucket
    rng = np.random.default_rng(3)
    v = np.sort(np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e9, 500), 10.0 ** rng.uniform(-300, 300, 500), [0.0, -1.0, 1.0]]))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    b = [r.b for r in df.select("i", ordered_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert (np.diff(b) >= 0).all()
