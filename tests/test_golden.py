"""Golden values worked from the reference's formulas and tests (FIXTURES.md part C)."""

import numpy as np
from pyspark.sql import functions as F

from agrolens.operators import export, ingest, location, rules


def test_normalize_and_yield(spark):
    df = spark.createDataFrame([("Rice", 1000.0, 500.0), ("  MAIZE  ", 100.0, 0.0)],
                               "c string, production_tonnes double, area_ha double")
    out = ingest.compute_yield(df).select(ingest.normalize_crop(F.col("c")).alias("c"), "yield_kg_ha").collect()
    assert [r.c for r in out] == ["rice", "maize"]
    assert out[0].yield_kg_ha == 2000.0 and out[1].yield_kg_ha is None


def test_rule_scores_tie_keeps_rule_order():
    x = np.array([[90, 42, 43, 25, 80, 6.5, 200]], dtype=float)
    s = rules.score_matrix(x)[0]
    crops = list(rules._CROPS)
    assert s[crops.index("rice")] == 1.0 and s[crops.index("jute")] == 1.0
    order = np.argsort(-s, kind="stable")
    assert crops[order[0]] == "rice" and crops[order[1]] == "jute"


def test_rule_missing_value_scores_zero():
    x = np.array([[90, 42, 43, 25, 80, np.nan, 200]], dtype=float)
    t = rules.term_matrix(x)[0]
    assert (t[:, 5] == 0).all()


def test_rule_top3_dataframe(spark):
    df = spark.createDataFrame([("a", 90.0, 42.0, 43.0, 25.0, 80.0, 6.5, 200.0)],
                               "id string, N_kg_ha double, P_kg_ha double, K_kg_ha double, avg_temp_c double, "
                               "humidity_pct double, pH double, avg_precip_mm double")
    out = rules.rule_top(df, ["id"]).orderBy("rank").collect()
    assert [r.crop for r in out][:2] == ["rice", "jute"]
    assert abs(sum(r.probability for r in out) - 1.0) < 1e-3
    assert out[0].expected_yield_kg_ha == 2500.0


def test_nearest_ports_and_logistics(spark):
    df = spark.createDataFrame([(1, 12.9716, 77.5946)], "location_id int, latitude double, longitude double")
    p = export.with_nearest_ports(df, 3).select(F.inline("ports")).collect()
    assert [(r.name, r.distance_km, r.transit_hours) for r in p] == [
        ("Chennai Port", 377.0, 9.4), ("Mangalore Port (NMPT)", 386.0, 9.6), ("Kochi Port", 478.0, 12.0)]
    one = export.with_nearest_ports(df, 1)
    score = one.select(F.round(export.logistics_score(F.col("ports")[0], F.lit(False)), 1).alias("s")).first().s
    assert score == 91.2


def test_target_month_and_timing(spark):
    months = [export.target_month(f"2025-{m:02d}-15") for m in range(1, 13)]
    assert months == [4, 4, 4, 7, 7, 7, 10, 10, 10, 1, 1, 1]
    df = spark.createDataFrame([([10, 11, 12, 1, 2],)], "peak array<int>")
    got = [df.select(export.timing_score(F.col("peak"), m).alias("t")).first().t for m in (10, 9, 3, 8, 6)]
    assert got == [90.0, 60.0, 35.0, 35.0, 15.0]


def test_suitability_fallbacks(spark):
    df = spark.createDataFrame([("rice", None), ("tea", None), ("tea", "punjab"), ("rice", "Atlantis"),
                                ("tea", "Atlantis")], "crop string, state string")
    out = [r.suitability_score for r in export.suitability(spark, df).collect()]
    assert sorted(out) == sorted([60, 50, 45, 60, 45])


def test_export_score_rice_karnataka(spark):
    loc = spark.createDataFrame([(1, 12.9716, 77.5946, "Karnataka")],
                                "location_id int, latitude double, longitude double, state string")
    # month 10: as_of in September with the "current month" window
    s = export.export_scores(spark, loc, "2025-10-15", window="current").where("crop = 'rice'").first()
    assert (s.demand_score, s.price_score, s.logistics_score, s.timing_score, s.regulatory_score) == \
        (50.4, 50.0, 91.2, 90.0, 90.0)
    assert s.suitability_score == 80 and s.export_score == 68.4 and s.confidence == 62.9
    rec = spark.createDataFrame([(1, "rice")], "location_id int, crop string")
    b = export.export_scores(spark, loc, "2025-10-15", window="current", recommended=rec).where("crop = 'rice'").first()
    assert b.export_score == 83.4


def test_soil_units_and_npk(spark):
    payload = ('{"properties":{"layers":[{"name":"phh2o","depths":[{"label":"0-5cm","values":{"mean":65}}]},'
               '{"name":"clay","depths":[{"label":"0-5cm","values":{"mean":250}}]},'
               '{"name":"soc","depths":[{"label":"0-5cm","values":{"mean":120}}]},'
               '{"name":"nitrogen","depths":[{"label":"0-5cm","values":{"mean":500}}]},'
               '{"name":"cec","depths":[{"label":"0-5cm","values":{"mean":150}}]}]}}')
    df = spark.createDataFrame([(1, payload), (2, "{}")], "location_id int, payload string")
    r = location.parse_soil(df).orderBy("location_id").collect()
    assert (r[0].pH, r[0].clay_pct, r[0].soc_g_kg, r[0].nitrogen_g_kg, r[0].cec_mmol_kg) == (6.5, 25.0, 12.0, 5.0, 150.0)
    assert r[1].pH is None
    soil = spark.createDataFrame([(12.0, 2.0, 150.0, 25.0), (None, None, None, None)],
                                 "soc_g_kg double, nitrogen_g_kg double, cec_mmol_kg double, clay_pct double")
    n = location.estimate_npk(soil).collect()
    assert (n[0].N_kg_ha, n[0].P_kg_ha, n[0].K_kg_ha) == (117.0, 35.0, 351.9)
    assert (n[1].N_kg_ha, n[1].P_kg_ha, n[1].K_kg_ha) == (50.0, 25.0, 25.0)


def test_weather_normals(spark):
    rows = [(1, f"2024-01-0{i + 1}", float(t), float(tx), float(tn), float(p), float(h)) for i, (t, tx, tn, p, h) in
            enumerate(zip([25, 26, 27], [30, 31, 32], [20, 21, 22], [5, 0, 10], [70, 72, 68]))]
    df = spark.createDataFrame(rows, "location_id int, d string, t_mean double, t_max double, t_min double, "
                                     "precip double, humidity double")
    r = location.weather_normals(df).first()
    assert (r.avg_temp_c, r.humidity_pct, r.temp_max_c, r.temp_min_c, r.avg_precip_mm, r.data_points) == \
        (26.0, 70.0, 31.0, 21.0, 15.0, 3)
    df2 = spark.range(365).select(F.lit(1).alias("location_id"), F.lit(25.0).alias("t_mean"),
                                  F.lit(30.0).alias("t_max"), F.lit(20.0).alias("t_min"),
                                  F.lit(3.0).alias("precip"), F.lit(70.0).alias("humidity"))
    assert location.weather_normals(df2).first().avg_precip_mm == 1095.0


def test_location_classification(spark):
    vals = ["560001", "110001", "56000", "5600012", "abc123", "12.9716,77.5946", "12.97 , 77.59",
            "-33.8,151.2", "12.97", "abc,def", "not-a-location", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, location string")
    kinds = [r.kind for r in location.classify_location(df).orderBy("id").collect()]
    assert kinds == ["pin", "pin", "unrecognised", "unrecognised", "unrecognised", "coords", "coords",
                     "coords", "unrecognised", "unrecognised", "unrecognised", "empty"]


def test_rule_top_any_k(spark):
    df = spark.createDataFrame([("a", 90.0, 42.0, 43.0, 25.0, 80.0, 6.5, 200.0)],
                               "id string, N_kg_ha double, P_kg_ha double, K_kg_ha double, avg_temp_c double, "
                               "humidity_pct double, pH double, avg_precip_mm double")
    for k in (1, 5, 22):
        out = rules.rule_top(df, ["id"], k).orderBy("rank").collect()
        assert len(out) == k and out[0].crop == "rice" and abs(sum(r.probability for r in out) - 1) < 2e-3


def test_validation_fails_without_target_or_location(spark):
    from agrolens.operators import validation
    cols = "sample_id string, location_id int, target_crop string, N_kg_ha double"
    df = spark.createDataFrame([(str(i), i % 3, "rice", 50.0) for i in range(30)], cols)
    for absent, check in (("target_crop", "target_cardinality"), ("location_id", "location_ids_present")):
        checks = validation.validation_checks(df.drop(absent))
        row = checks.where(F.col("name") == check).first()
        assert (row.severity, row.passed) == ("critical", False)
        assert validation.validation_report(checks).first().overall_status == "FAIL"
    dup = validation.validation_checks(df.union(df.limit(4)).union(df.limit(2).withColumn("sample_id", F.lit(None).cast("string"))))
    assert dup.where("name = 'no_duplicate_sample_ids'").first().metric == 5.0


def test_recommended_crops_become_candidates(spark):
    loc = spark.createDataFrame([(1, "Karnataka", 12.97, 77.59), (2, None, 19.0, 73.0)], "location_id bigint, state string, latitude double, longitude double")
    rec = spark.createDataFrame([(1, 1, "Banana"), (1, 2, "rice"), (2, 1, "jute"), (2, 2, "grapes")], "location_id bigint, rank int, crop string")
    out = {(r.location_id, r.crop): r for r in export.export_scores(spark, loc, "2025-01-15", recommended=rec).collect()}
    assert out[1, "banana"].ml_recommended and out[2, "jute"].ml_recommended and not out[2, "rice"].ml_recommended
    base = {(r.location_id, r.crop): r for r in export.export_scores(spark, loc, "2025-01-15").collect()}
    assert (1, "banana") not in base and (2, "grapes") not in out and set(base) < set(out)  # grapes have no export data
    assert out[1, "rice"].export_score >= base[1, "rice"].export_score


def test_shared_folder_is_required_off_local_masters(monkeypatch):
    import pytest

    from agrolens import session

    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        session.shared_dir(Session, "x")
