"""The parts of the learning and rule queries that each row passes, against plain versions."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from agrolens.ml import attribution, boosting, models
from agrolens.ml.boosting import Booster, Params
from agrolens.operators import rules


def grown(depth, classes=3, features=6):
    rnd = np.random.default_rng(depth)
    m = Booster([f"f{i}" for i in range(features)], [np.arange(63.0)] * features, Params(depth=depth), classes)
    m.open_round()
    for k in range(classes):
        todo = [(0, 0)]
        while todo:
            n, d = todo.pop()
            m.cover[0, k, n] = 2.0 ** (depth - d)
            if d < depth and (d < 2 or rnd.random() < 0.9):
                m.feature[0, k, n], m.bin[0, k, n] = rnd.integers(features), rnd.integers(62)
                todo += [(2 * n + 1, d + 1), (2 * n + 2, d + 1)]
    m.value = rnd.normal(size=m.value.shape)
    return m, rnd.integers(0, 64, (400, features)).astype(np.uint8)


def test_rows_reach_the_nodes_of_a_plain_descent():
    for depth in (1, 3, 7, 9):  # few splits a level, many, and more nodes than a byte holds
        m, x = grown(depth)
        for k in range(m.classes):
            plain = []
            for row in x:
                n = 0
                while m.feature[0, k, n] >= 0:
                    n = 2 * n + 1 + int(row[m.feature[0, k, n]] > m.bin[0, k, n])
                plain.append(n)
            assert (m.nodes(x, 0)[:, k] == plain).all() and np.array_equal(m.margins(x)[:, k], m.value[0, k, plain])


def test_sizes_of_attributions_are_summed_over_rows_and_classes(spark):
    m, x = grown(3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], m.features).repartition(3)
    got = attribution.booster_sizes(df, m).groupBy("j").agg((F.sum("size") / F.sum("n")).alias("v")).orderBy("j").collect()
    bins = m.binned(x.astype(float)).astype(float)
    plain = np.mean([np.abs(attribution.Attributor(attribution.booster_leaves(m, k), 6)(bins)) for k in range(3)], axis=(0, 1))
    assert np.allclose([r.v for r in got], plain)


def test_edges_of_indicators_equal_their_sketches(spark):
    cols = ["even", "rare", "common", "none", "all", "x"]
    rows = [(float(i % 2), float(i % 1000 == 0), float(i % 1000 != 0), 0.0, 1.0, float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, cols)
    one, two = boosting.quantile_edges(df, cols), boosting.quantile_edges(df, cols, indicators=[0, 1, 2, 3, 4])
    assert all(np.array_equal(a, b) for a, b in zip(one, two)) and len(two[0]) == 1 and len(two[5]) == 63


def test_one_partition_is_dealt_over_all_cores(spark):
    df = spark.range(2000).coalesce(1)
    assert df.rdd.getNumPartitions() == 1
    parts = boosting.spread(df, ["id"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism


def test_classifier_data_is_stored(spark):
    """The fit's passes read a table, not the features made anew."""
    from agrolens.plans.common import samples
    data, cols = models.classifier_data(samples(spark, "/root/testdata/sf0.001"), ["row_uid"])
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "is_test" in data.columns and len(cols) == len(data.columns) - 5


def test_scores_equal_the_mean_of_the_terms():
    rnd = np.random.default_rng(3)
    x = rnd.uniform(-50, 400, (500, 7))
    x[rnd.random(x.shape) < 0.1] = np.nan
    x[0], x[1], x[2] = np.inf, -np.inf, rules._LO[0]
    terms = rules.term_matrix(x)
    plain = terms[:, :, 0]
    for j in range(1, 7):
        plain = plain + terms[:, :, j]
    assert np.array_equal(rules.score_matrix(x), plain / 7.0)


def test_half_up_is_the_rounding_of_spark(spark):
    rnd = np.random.default_rng(4)
    v = np.concatenate([rnd.random(2000), rnd.integers(0, 10 ** 5, 2000) / 1e5, [0.0, 1.0, 0.00005, 0.99995, 0.285, float(Decimal("0.12345"))]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    for digits in (4, 6):
        got = [r.r for r in df.select("i", F.round("v", digits).alias("r")).orderBy("i").collect()]
        assert np.array_equal(rules.half_up(v, digits), got)
