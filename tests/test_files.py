"""File sources and sinks: what is written reads back the same."""

import glob
import json

from agrolens.operators import ingest, validation
from agrolens.sources import files


def test_sample_csv_keeps_bad_lines(spark, tmp_path):
    path = tmp_path / "crops.csv"
    path.write_text("N,P,K,temperature,humidity,ph,rainfall,label\n90,42,43,20.9,82.0,6.5,202.9, Rice \nx,1,2,3,4,5,6,maize\n")
    rows = files.read_csv(spark, str(path), files.SAMPLE_CSV).orderBy("label").collect()
    assert len(rows) == 2 and rows[0].label.strip() == "Rice" and rows[0]._corrupt_record is None
    assert rows[1].N is None and rows[1].P == 1.0 and rows[1]._corrupt_record.startswith("x,1")


def test_production_csv_to_cleaned_table(spark, tmp_path):
    path = tmp_path / "production.csv"
    path.write_text("State_Name,District_Name,Crop_Year,Season,Crop,Area,Production\nKerala,X,2015,Kharif,Rice,2.0,5.0\nKerala,Y,2016,Rabi,Maize,0.0,1.0\n")
    clean = ingest.production_canonical(files.read_csv(spark, str(path), files.PRODUCTION_CSV).drop("_corrupt_record"))
    out = str(tmp_path / "clean")
    files.write_table(clean, out, ("season",))
    back = spark.read.parquet(out)
    assert sorted(map(str, back.select(*clean.columns).collect())) == sorted(map(str, clean.collect()))
    assert sorted(str(r.yield_kg_ha) for r in back.collect()) == ["2500.0", "None"]


def test_validation_report_json(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i % 3, "rice") for i in range(12)], "sample_id string, location_id int, target_crop string")
    checks = validation.validation_checks(df)
    files.write_report(checks, str(tmp_path / "report"))
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/report/*.json") for x in open(f)]
    assert {x["name"]: x["passed"] for x in lines} == {r.name: r.passed for r in checks.collect()}
