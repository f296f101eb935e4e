"""Boosted trees, their attributions, the seeded search and the model registry against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from agrolens.ml import attribution, boosting
from agrolens.ml.boosting import Booster, Params

COLS = ["a", "b", "c", "flag"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 3)).round(3)
    flag = rnd.integers(0, 2, 3000)
    y = np.where(x[:, 0] + x[:, 1] * flag > 0.3, 2, np.where(x[:, 2] > 0, 1, 0))
    y = np.where(rnd.random(3000) < 0.05, rnd.integers(0, 3, 3000), y)
    data = [(i, *map(float, v), float(f), int(k), i % 4) for i, (v, f, k) in enumerate(zip(x, flag, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, flag double, label int, fold int").repartition(5).cache()


@pytest.fixture(scope="module")
def model(rows):
    return boosting.fit(rows.where("fold > 0"), COLS, "label", 3, Params(rounds=6, depth=3, rate=0.3, subsample=1.0, colsample=1.0, min_child_weight=1.0), ["id"])


def plain_margins(x, y, edges, p, rounds):
    """The same boosting in plain code, one node at a time."""
    n, k_all = len(x), int(y.max()) + 1
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margins = np.zeros((n, k_all))
    score = lambda g, h: max(abs(g) - p.alpha, 0) ** 2 / (h + p.lam)
    for _ in range(rounds):
        e = np.exp(margins - margins.max(1, keepdims=True))
        prob = e / e.sum(1, keepdims=True)
        step = np.zeros_like(margins)
        for k in range(k_all):
            g, h = prob[:, k] - (y == k), np.maximum(2 * prob[:, k] * (1 - prob[:, k]), 1e-16)

            def grow(at, depth):
                G, H = g[at].sum(), h[at].sum()
                best = (1e-9, None)
                for f, b in itertools.chain(*([(f, b) for b in range(len(edges[f]) + 1)] for f in range(x.shape[1]))):
                    left = at[bins[at, f] <= b]
                    right = at[bins[at, f] > b]
                    if min(len(left), len(right)) < 1 or min(h[left].sum(), h[right].sum()) < p.min_child_weight:
                        continue
                    gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(G, H)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
                if depth == 0 or best[1] is None:
                    step[at, k] = -np.sign(G) * max(abs(G) - p.alpha, 0) / (H + p.lam) * p.rate
                    return
                for side in best[1]:
                    grow(side, depth - 1)

            grow(np.arange(n), p.depth)
        margins += step
    return margins


def test_boosting_equals_a_plain_version(rows):
    some = rows.where("id < 400")
    p = Params(rounds=3, depth=3, rate=0.3, subsample=1.0, colsample=1.0, min_child_weight=1.0)
    got = boosting.fit(some, COLS, "label", 3, p, ["id"])
    data = some.orderBy("id").collect()
    x, y = np.array([[r[c] for c in COLS] for r in data]), np.array([r.label for r in data])
    assert np.allclose(got.margins(got.binned(x)), plain_margins(x, y, got.edges, p, 3), atol=1e-6)


def test_boosting_learns_and_repeats(rows, model):
    held = rows.where("fold = 0").withColumn("p", boosting.probabilities(model, rows.sparkSession))
    row = held.select(F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("int")), F.max(F.abs(F.aggregate("p", F.lit(0.0), lambda s, v: s + v) - 1))).first()
    assert row[0] > 0.85 and row[1] < 1e-9
    p = Params(rounds=7, depth=2, rate=0.3, subsample=0.7, colsample=0.5)  # past a refresh
    one, two = (boosting.fit(rows, COLS, "label", 3, p, ["id"]) for _ in range(2))
    assert (one.feature == two.feature).all() and np.array_equal(one.value, two.value) and len(one.feature) == 7


def expected(model, k, x, known):
    """A class's expectation when only ``known`` features are: by descending into both children of unknown splits."""
    def down(r, n):
        f = model.feature[r, k, n]
        if f < 0:
            return model.value[r, k, n]
        left, right = 2 * n + 1, 2 * n + 2
        if f in known:
            return down(r, left if x[f] <= model.bin[r, k, n] else right)
        c = model.cover[r, k]
        return (c[left] * down(r, left) + c[right] * down(r, right)) / c[n]
    return sum(down(r, 0) for r in range(len(model.feature)))


def shapley(value, n):
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for s in range(n):
            w = math.factorial(s) * math.factorial(n - 1 - s) / math.factorial(n)
            for coalition in itertools.combinations(others, s):
                out[i] += w * (value({*coalition, i}) - value(set(coalition)))
    return out


def test_attributions_are_shapley_values(rows, model):
    data = rows.where("fold = 0 AND id < 60").collect()
    x = model.binned(np.array([[r[c] for c in COLS] for r in data])).astype(float)
    for k in range(3):
        leaves = attribution.booster_leaves(model, k)
        got = attribution.Attributor(leaves, 4)(x)
        base = attribution.expectation(leaves)[0]
        for row, phi in zip(x, got):
            assert np.allclose(phi, shapley(lambda s: expected(model, k, row, s), 4), atol=1e-9)
        assert np.allclose(base + got.sum(1), model.margins(x.astype(np.uint8))[:, k])


def test_attributions_of_every_held_out_row_sum_to_the_margin(rows, model):
    spark = rows.sparkSession
    held = rows.where("fold = 0").withColumn("p", boosting.probabilities(model, spark))
    got = held.withColumn("s", attribution.booster_attributions(model, spark, F.array(F.lit(0), F.lit(1), F.lit(2))))
    total = F.transform("s", lambda s: s["base"] + F.aggregate(s["contributions"], F.lit(0.0), lambda a, v: a + v))
    e = F.transform(total, F.exp)
    norm = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    worst = got.withColumn("e", e).withColumn("n", norm).select(F.max(F.array_max(F.zip_with("e", "p", lambda v, p: F.abs(v / F.col("n") - p))))).first()[0]
    assert worst < 1e-9


def test_forest_attributions_sum_to_the_probability(rows, spark, tmp_path):
    data = VectorAssembler(inputCols=COLS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=5, maxDepth=4, seed=3).fit(data.where("fold > 0"))
    forest.write().save(str(tmp_path / "rf"))
    leaves = attribution.forest_leaves(spark, str(tmp_path / "rf"), 5)
    scored = forest.transform(data.where("fold = 0"))
    got = scored.withColumn("s", attribution.forest_attributions(scored, leaves, COLS, F.col("prediction").cast("int")))
    p = F.get(vector_to_array("probability"), F.col("prediction").cast("int"))
    total = F.col("s.base") + F.aggregate("s.contributions", F.lit(0.0), lambda a, v: a + v)
    assert got.select(F.max(F.abs(p - total))).first()[0] < 1e-9


def test_unit_table_of_one_and_none():
    assert np.allclose(attribution.unit_table(np.array([0.25])), [[-0.25], [0.75]])
    assert attribution.unit_table(np.array([])).shape == (1, 0)


def test_sampled_settings_repeat():
    one, two = (boosting.sampled_settings(6, 5, (50, 500)) for _ in range(2))
    assert one == two and one != boosting.sampled_settings(6, 6, (50, 500))
    assert {b for b, _ in one} == {"boosted_weight", "boosted_samples"}


def test_search_stops_the_worse_half(rows):
    edges = boosting.quantile_edges(rows, COLS)
    binned = boosting.prepared(rows, COLS, edges, "label", F.col("fold"), ["id"])
    settings = [("boosted_weight", Params(rounds=6, depth=d, rate=r, subsample=1.0, colsample=1.0, min_child_weight=1.0)) for d, r in ((1, 0.01), (3, 0.3), (1, 0.02), (3, 0.2))]
    got = boosting.search(binned, COLS, edges, 3, settings, [0, 1], halve_at=(2,), k=1)
    assert len(got) == 4 and sum(r["stopped_early"] for r in got) == 2
    assert {r["trial"] for r in got[:2]} == {1, 3} and all(r["rounds"] == (2 if r["stopped_early"] else 6) for r in got)
    alone = boosting.fit_many(binned, {0: (Booster(COLS, edges, settings[1][1], 3), 0)})[0][0]
    n, hit = boosting.hits(binned, {0: (alone, 0)}, 1)[0]
    n1, hit1 = boosting.hits(binned, {0: (boosting.fit_many(binned, {0: (Booster(COLS, edges, settings[1][1], 3), 1)})[0][0], 1)}, 1)[0]
    assert next(r for r in got if r["trial"] == 1)["top3_accuracy"] == pytest.approx((hit / n + hit1 / n1) / 2)


def test_exclusive_groups_change_nothing(rows):
    """Indicators of one column, summed as one column: the same trees."""
    cut = F.when(F.col("b") < -0.5, 0).when(F.col("b") < 0.5, 1).otherwise(2)
    data = rows.select("*", *[(cut == i).cast("double").alias(f"b_{i}") for i in range(3)])
    cols = ["a", "b_0", "c", "b_1", "b_2", "flag"]
    p = Params(rounds=3, depth=3, rate=0.3, subsample=0.9, colsample=1.0, min_child_weight=1.0)
    one = boosting.fit(data, cols, "label", 3, p, ["id"])
    two = boosting.fit(data, cols, "label", 3, p, ["id"], exclusive=[[1, 3, 4]])
    assert (one.feature == two.feature).all() and np.allclose(one.value, two.value, atol=1e-9) and (one.feature == 1).any()


def test_registry_round_trip(rows, model, spark, tmp_path):
    from agrolens.ml import registry
    root = f"file://{tmp_path}/store"
    with pytest.raises(LookupError):
        registry.load(spark, root, "crop")
    one = registry.save(spark, root, "crop", "boosted", model)
    other = boosting.fit(rows, COLS, "label", 3, Params(rounds=2, depth=2, rate=0.3), ["id"])
    two = registry.save(spark, root, "crop", "boosted", other)
    assert (one.version, two.version) == (1, 2) and one.checksum != two.checksum
    assert [r.version for r in registry.versions(spark, root, "crop").collect()] == [1, 2]
    back, saved = registry.load(spark, root, "crop", 1)
    assert saved.checksum == one.checksum and back.params == model.params and back.features == model.features
    x = model.binned(np.array([[r[c] for c in COLS] for r in rows.limit(200).collect()]))
    assert np.array_equal(back.margins(x), model.margins(x)) and np.array_equal(back.cover, model.cover)
    assert len(registry.load(spark, root, "crop")[0].feature) == 2
    data = VectorAssembler(inputCols=COLS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=3, maxDepth=3, seed=3).fit(data)
    registry.save(spark, root, "forest", "forest", forest, {"numTrees": 3}, COLS)
    loaded, meta = registry.load(spark, root, "forest")
    key = lambda df: df.select("id", "prediction").orderBy("id").collect()
    assert key(loaded.transform(data)) == key(forest.transform(data)) and meta.features == COLS
    registry.save(spark, root, "medians", "table", rows.groupBy("label").agg(F.avg("a").alias("m")))
    assert registry.load(spark, root, "medians")[0].count() == 3
    spark.range(3).write.mode("append").parquet(f"{two.path}/trees")  # a file too many
    with pytest.raises(ValueError):
        registry.load(spark, root, "crop", 2)


def test_stored_model_scores_requests(spark):
    from agrolens.ml import serving
    from agrolens.plans import q_ml
    from agrolens.plans.registry import load_all
    reg, sf = load_all(), "/root/testdata/sf0.001"
    got = reg["scored_requests_model"].build(spark, sf)
    n = reg["holdout_split"].build(spark, sf).count()
    rows = got.limit(50).collect()
    assert n and got.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert {r.model_checksum for r in rows} == {q_ml._classifier(spark, sf)[1].checksum}
    assert all(r.result.count("|") == 2 and '"contribution"' in r.top for r in rows)
    mae = spark.createDataFrame([(None, 5.0), ("rice", 4.0)], "target_crop string, mae double")  # the yield model is not fitted here
    weights = spark.createDataFrame([("pH", 0.1)], "feature string, importance double")
    report = {(r.scope, r.metric): r.value for r in serving.report(q_ml._scored(spark, sf), mae, weights).collect()}
    assert report["overall", "yield_mae"] == 5.0 and report["rice", "yield_mae"] == 4.0 and report["pH", "importance"] == 0.1
    assert report["overall", "top3_accuracy"] >= 0.75 and report["overall", "target_met"] == 1.0
    cells = sum(v for (_, m), v in report.items() if m.startswith("predicted:"))
    assert cells == report["overall", "test_set_size"] == sum(v for (_, m), v in report.items() if m == "support")
    assert reg["model_gate"].build(spark, sf).first().passed
