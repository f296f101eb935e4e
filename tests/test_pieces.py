"""Growth over pieces of rows, and ranks and explanations made in the kernel, against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from agrolens.ml import attribution, boosting
from agrolens.ml.boosting import Booster, Columns, Params


def test_sums_have_the_digits_of_row_by_row_sums():
    rnd = np.random.default_rng(2)
    sizes, exclusive = np.array([5, 1, 2, 2, 2, 9, 1, 2, 2]), [[2, 3, 4], [6, 7, 8]]  # a whole group, and one with an indicator that is never set
    columns = Columns(sizes, exclusive)
    x = np.stack([rnd.integers(0, s, 700) for s in sizes]).astype(np.uint8)
    x[3] &= 1 - x[2]
    x[4] &= 1 - (x[2] | x[3])
    codes, classes = columns.codes(x), 3
    grad, hess = rnd.normal(size=(classes, 700)), rnd.random((classes, 700))
    for many in (1, 2, 4):
        at = None if many == 1 else rnd.integers(-1, many, (classes, 700))
        sums = np.zeros((classes, 3, many, columns.width))
        columns.add(sums, codes, at, many, grad, hess)
        plain = np.zeros_like(sums)
        for k in range(classes):
            for c, start in zip(codes, columns.at):
                for r in range(700):
                    n = 0 if at is None else at[k, r]
                    if n >= 0:
                        plain[k, :, n, start + c[r]] += (grad[k, r], hess[k, r], 1)
        assert np.array_equal(sums, plain)


def test_a_pass_reads_pieces_and_margins_stay_with_their_rows(spark):
    rnd = np.random.default_rng(3)
    data = [(i, float(rnd.integers(0, 40)), float(rnd.integers(0, 2)), int(rnd.integers(0, 3)), i % 3) for i in range(2500)]
    df = spark.createDataFrame(data, "id long, a double, flag double, label int, fold int").repartition(3)
    cols, edges = ["a", "flag"], [np.arange(39.0), np.array([0.0])]
    rows = boosting.prepared(df, cols, edges, "label", F.col("fold"), ["id"])
    assert rows.count() <= spark.sparkContext.defaultParallelism  # 2,500 rows would be read one by one
    model = Booster(cols, edges, Params(rounds=5, depth=2, subsample=1.0, min_child_weight=0.5), 3)
    boosting.fit_many(rows, {0: (model, None)})
    kept = boosting._refreshed(rows, {0: (model, None)}, 0)
    got = []
    for r in kept.collect():
        x = np.frombuffer(r.x, np.uint8).reshape(2, r.n)
        assert np.allclose(np.frombuffer(r.m, np.float32).reshape(3, r.n), model.margins(x.T).T, atol=1e-6)
        got += zip(x[0].tolist(), x[1].tolist(), np.frombuffer(r.y, np.int32).tolist(), np.frombuffer(r.fold, np.int32).tolist())
    assert sorted(got) == sorted((int(a), int(f), y, fold) for _, a, f, y, fold in data)


def test_ranks_and_explanations_equal_those_of_every_class(spark):
    rnd = np.random.default_rng(4)
    features = ["b", "a", "flag"]
    m = Booster(features, [np.arange(20.0), np.arange(9.0), np.array([0.0])], Params(depth=2), 4)
    for _ in range(3):
        m.open_round()
    for r in range(3):
        for k in range(4):
            for n in range(3):
                m.feature[r, k, n] = rnd.integers(3)
                m.bin[r, k, n] = 0 if m.feature[r, k, n] == 2 else rnd.integers(8)
            m.cover[r, k] = [8, 4, 4, 2, 2, 2, 2]
    m.value = rnd.normal(size=m.value.shape)
    m.value[:, 3] = m.value[:, 1]  # classes 1 and 3 tie where their trees agree
    m.feature[:, 3], m.bin[:, 3] = m.feature[:, 1], m.bin[:, 1]
    df = spark.createDataFrame([(i, float(rnd.integers(0, 22)), float(rnd.integers(0, 11)), float(rnd.integers(0, 2))) for i in range(500)], ["id", *features]).repartition(3)
    all_of = attribution.booster_attributions(m, spark, F.array(*[F.lit(k) for k in range(4)]))
    got = df.select("id", boosting.probabilities(m, spark).alias("p"), all_of.alias("s"), boosting.ranked(m, spark).alias("all"), attribution.explained(m, spark, 2, 2).alias("e"), attribution.named(F.col("e.top")[0], features).alias("names")).collect()
    ties = 0
    for r in got:
        order = sorted(range(4), key=lambda k: (-r.p[k], -k))
        ties += r.p[1] == r.p[3]
        assert [s.class_idx for s in r.all] == order and [s.probability for s in r.all] == [r.p[k] for k in order]
        assert [s.class_idx for s in r.e] == order[:2] and [s.probability for s in r.e] == [r.p[k] for k in order[:2]]
        for s in r.e:
            values = r.s[s.class_idx].contributions
            want = sorted(range(3), key=lambda j: (-abs(values[j]), features[j]))[:2]
            assert [t.place for t in s.top] == want and [t.contribution for t in s.top] == [values[j] for j in want]
        assert [t.feature for t in r.names] == [features[t.place] for t in r.e[0].top]
    assert ties == 500


def test_tables_of_attributions_are_made_once_for_many_batches(monkeypatch):
    m = Booster(["a", "b"], [np.arange(9.0)] * 2, Params(depth=2), 2)
    m.open_round()
    m.feature[0, :, :3], m.bin[0, :, :3], m.cover[0] = [0, 1, 0], [4, 2, 6], [8, 4, 4, 2, 2, 2, 2]
    m.value = np.random.default_rng(1).normal(size=m.value.shape)
    made, calls = {}, []
    plain = attribution.unit_table
    monkeypatch.setattr(attribution, "unit_table", lambda share: calls.append(1) or plain(share))
    for _ in range(4):
        x = np.random.default_rng(5).integers(0, 10, (2, 50)).astype(np.uint8)
        picked = np.arange(50) % 2
        base, got = attribution._by_class(m, made, x, picked, np.arange(50), 2)
    assert len(calls) <= 2 * 4 and np.allclose(base + got.sum(1), m.summed(x)[picked, np.arange(50)])


def test_the_search_has_the_size_of_the_reference():
    from agrolens.plans import q_ml
    settings = boosting.sampled_settings(q_ml.SEARCH["trials"], q_ml.SEARCH["seed"], q_ml.SEARCH["rounds"], Params(depth=q_ml.SEARCH["depth"]))
    assert len(settings) == 30 and q_ml.SEARCH["rounds"] == (50, 500) and min(q_ml.SEARCH["halve_at"]) > 100
    assert min(p.rounds for _, p in settings) >= 50 and max(p.rounds for _, p in settings) > 300
    assert {p.depth for _, p in settings} >= {3, 10}


def test_sums_beyond_their_bound_take_further_passes_and_the_same_trees(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(rnd.integers(0, 40)), float(rnd.integers(0, 40)), int(rnd.integers(0, 3)), i % 2) for i in range(600)], "id long, a double, b double, label int, fold int")
    cols, edges = ["a", "b"], [np.arange(39.0)] * 2
    rows = boosting.prepared(df, cols, edges, "label", F.col("fold"), ["id"], 100)
    grown = []
    for bound in (boosting.SUMS_BYTES, 24 * 80 * 2 * 2):  # the second: two classes at the root's children, one below
        monkeypatch.setattr(boosting, "SUMS_BYTES", bound)
        models = {j: (Booster(cols, edges, Params(rounds=6, depth=3, rate=0.3, subsample=0.9, min_child_weight=0.5), 3), j) for j in range(2)}
        grown.append([m for m, _ in boosting.fit_many(rows, models).values()])
        assert len([*boosting._blocks(models, 2)]) == (1 if bound > 10 ** 6 else 6)
    for one, two in zip(*grown):
        assert (one.feature >= 0).any() and np.array_equal(one.feature, two.feature) and np.array_equal(one.value, two.value)
