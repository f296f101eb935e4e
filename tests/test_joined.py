"""Seasonal merge, field trial, fitted encoder and the location job's modes on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from agrolens.functions.ranking import group_row_number
from agrolens.ml import models
from agrolens.operators import features, location, location_job, seasonal, trial


def test_season_and_its_year(spark):
    days = ["2020-01-15", "2020-03-31", "2020-04-01", "2020-06-01", "2020-10-31", "2020-11-01", "2020-12-31"]
    season, began = seasonal.season_of(F.col("d"))
    got = spark.createDataFrame([(x,) for x in days], "d string").select(F.col("d").cast("date").alias("d")).select(season, began).collect()
    assert [tuple(r) for r in got] == [("rabi", 2019), ("rabi", 2019), ("zaid", 2020), ("kharif", 2020), ("kharif", 2020), ("rabi", 2020), ("rabi", 2020)]


def test_merge_aligns_seasons(spark):
    made = spark.createDataFrame([(1, "Rabi", 2019, "wheat", 10.0, 20.0), (1, " whole year", 2019, "wheat", 10.0, 40.0), (1, "Rabi", 2018, "wheat", 0.0, 5.0), (2, "Autumn", 2019, "rice", 1.0, 1.0),
                                  (None, "Rabi", 2019, "wheat", 1.0, 1.0)], "location_id int, season string, year int, target_crop string, area_ha double, production_tonnes double")
    wx = spark.createDataFrame([(1, "2019-12-01", 10.0, 1.0), (1, "2020-02-01", 20.0, 2.0), (1, "2020-12-01", 30.0, 5.0), (1, "2019-07-01", None, 7.0)], "location_id int, d string, t_mean double, precip double").withColumn("d", F.col("d").cast("date"))
    soil = spark.createDataFrame([(1, 6.0, 1.0, 2.0, 3.0)], "location_id int, pH double, N_kg_ha double, P_kg_ha double, K_kg_ha double")
    veg = spark.createDataFrame([(3, 50.0)], "location_id int, vegetation_score double")
    prices = spark.createDataFrame([("wheat", "2020-01-05", 100.0), ("wheat", "2021-01-05", 300.0), ("wheat", "2020-07-01", None), ("wheat", "2020-07-02", 0.0)], "crop string, arrival_date string, modal double").withColumn("arrival_date", F.col("arrival_date").cast("date"))
    got = {(r.season, r.season_year): r for r in seasonal.merge_location_season_crop(made, wx, soil, veg, prices).collect()}
    assert set(got) == {("rabi", 2018), ("rabi", 2019), ("kharif", 2019), ("zaid", 2019)}
    r = got["rabi", 2019]  # both records, the winter's two days, that winter's price
    assert (r.n_records, r.yield_kg_ha, r.avg_temp_c, r.season_rain_mm, r.weather_source, r.price_per_quintal, r.price_source, r.pH, r.vegetation_score) == (2, 3000.0, 15.0, 3.0, "year", 100.0, "year", 6.0, None)
    r = got["rabi", 2018]  # no weather or price of that year: the means over the years; no area, no yield
    assert (r.yield_kg_ha, r.avg_temp_c, r.season_rain_mm, r.weather_source, r.price_per_quintal, r.price_source) == (None, 20.0, 4.0, "normal", 200.0, "normal")
    r = got["kharif", 2019]
    assert (r.avg_temp_c, r.season_rain_mm, r.weather_source, r.price_per_quintal, r.price_source) == (None, 7.0, "year", None, None)
    assert got["zaid", 2019].weather_source is None


def test_assignment_is_balanced_within_strata(spark):
    clusters = spark.range(101).select(F.col("id").alias("c"), (F.col("id") % 3).alias("zone"))
    got = trial.assign(clusters.union(clusters), "c", ["zone"])
    assert got.count() == 101
    for r in got.groupBy("zone").agg(F.count_if(F.col("arm") == "treatment").alias("t"), F.count_if(F.col("arm") == "control").alias("k")).collect():
        assert r.t - r.k in (0, 1)
    assert got.exceptAll(trial.assign(clusters.repartition(7), "c", ["zone"])).count() == 0


def test_effects_by_hand(spark):
    rows = [("a", 10.0), ("a", 12.0), ("b", 20.0), ("b", None), ("c", 1.0), ("d", 3.0), ("d", 5.0)]
    arms = [("a", "treatment"), ("b", "treatment"), ("c", "control"), ("d", "control")]
    got = trial.effects(spark.createDataFrame(rows, "c string, y double"), spark.createDataFrame(arms, "c string, arm string"), "c", {"y": F.col("y")}).first()

    def arm(clusters):
        mean = sum(map(sum, clusters)) / sum(map(len, clusters))
        n = sum(map(len, clusters))
        return mean, 2 / 1 * sum((sum(c) - len(c) * mean) ** 2 for c in clusters) / n ** 2
    (mt, vt), (mc, vc) = arm([[10, 12], [20]]), arm([[1], [3, 5]])
    assert (got.treatment_rows, got.control_rows, got.treatment_clusters, got.control_clusters) == (3, 3, 2, 2)
    assert got.difference == pytest.approx(mt - mc, abs=1e-4) and got.ci_low == pytest.approx(mt - mc - 1.96 * math.sqrt(vt + vc), abs=1e-4)
    one = trial.effects(spark.createDataFrame(rows[:3] + rows[4:], "c string, y double"), spark.createDataFrame([("a", "treatment"), ("c", "control")], "c string, arm string"), "c", {"y": F.col("y")}).first()
    assert one.difference == 10.0 and one.ci_low is None


def test_fitted_encoder(spark):
    fit = spark.createDataFrame([("acidic", "low"), ("neutral", "low")], "pH_bin string, rainfall_bin string")
    new = spark.createDataFrame([("acidic", "high"), (None, "low"), ("odd", "low")], "pH_bin string, rainfall_bin string")
    state = features.fit_onehot(fit)
    assert state == sorted(["pH_bin_acidic", "pH_bin_neutral", "rainfall_bin_low"])
    got = features.transform_onehot(new, state)
    assert got.columns == state and [tuple(r) for r in got.collect()] == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)]
    assert set(features.transform_onehot(new, state, features.fit_onehot(new)).columns) == {*state, "pH_bin_odd", "rainfall_bin_high"}
    assert features.transform_onehot(new.drop("pH_bin"), state).first().pH_bin_acidic == 0.0


def test_global_rank_has_no_single_partition(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.lit(None).cast("int").alias("n"))
    got = group_row_number(rows, [F.desc("v")], "rn", 7)
    want = {v: i + 1 for i, v in enumerate(sorted((r.v for r in rows.collect()), reverse=True))}
    assert {r.v: r.rn for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert group_row_number(rows.limit(0), ["v"]).count() == 0


def test_modes_read_only_what_they_need(spark):
    from agrolens.plans.q_joined import location_run
    sf = "/root/testdata/sf0.001"

    def scans(mode):
        plan = location_run(spark, sf, mode, None)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")
    assert scans("dry_run") == 2 < scans("data_only") == scans("full_run")
    with pytest.raises(ValueError):
        location_run(spark, sf, "all")

    def never():
        raise AssertionError("read")
    places = spark.createDataFrame([(1, 2.0, 3.0, "s", "x", None)], "location_id int, latitude double, longitude double, state string, display_name string, error string")
    assert location_job.run("dry_run", lambda: places, never, never, never).count() == 1


def test_seasons_asked_by_name_and_degree_days(spark):
    rows = [(1, "2020-01-10", 20.0, 1.0), (1, "2020-11-10", 5.0, 2.0), (1, "2020-12-10", None, 3.0), (1, "2020-07-10", 30.0, 4.0), (2, None, 25.0, 1.0)]
    wx = spark.createDataFrame(rows, "location_id int, d string, t_mean double, precip double").withColumn("d", F.col("d").cast("date"))
    wx = wx.withColumns({"t_max": F.col("t_mean"), "t_min": F.col("t_mean"), "humidity": F.lit(60.0)})

    def normals(season, strict=False):
        return {r.location_id: (r.season, r.avg_temp_c, r.data_points) for r in location.seasonal_normals(wx, season, strict).collect()}

    assert normals(" Rabi") == {1: ("rabi", 12.5, 2)}
    assert normals("Rabi", True) == {1: ("rabi", 18.3, 3), 2: ("rabi", 25.0, 1)}  # the tag alone
    assert normals("monsoon") == {1: (None, 18.3, 3), 2: (None, 25.0, 1)} == normals("monsoon", True)
    got = {(r.crop, r.season_year): (r.gdd, r.n_days) for r in location.crop_degree_days(wx).collect()}
    assert got == {("wheat", 2019): (10.0, 1), ("wheat", 2020): (0.0, 1), ("rice", 2020): (15.0, 1)}
    got = {(r.crop, r.season_year): r.gdd for r in location.crop_degree_days(wx, floor_at_zero=False).collect()}
    assert got["wheat", 2020] == -5.0
    assert location.crop_degree_days(wx.limit(0)).count() == 0


def test_yield_model_blind_to_the_crop(spark):
    rows = [(i, ["rice", "wheat"][i % 2], "Rabi", 2000 + i // 2 % 5, f"D{i // 8}", 2.0, [1000.0, 9000.0][i % 2]) for i in range(80)]
    made = spark.createDataFrame(rows, "record_id long, target_crop string, season string, year int, district string, area_ha double, yield_kg_ha double")

    def guesses(strict):
        return {c: {round(r.predicted_yield) for r in models.train_yield(made, max_iter=2, strict_compat=strict).collect() if r.target_crop == c} for c in ("rice", "wheat")}

    seen, blind = guesses(False), guesses(True)
    assert max(seen["rice"]) < min(seen["wheat"]) and blind["rice"] == blind["wheat"]
