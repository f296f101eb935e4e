"""File sources and sinks of the ETL job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE_CSV = "N double, P double, K double, temperature double, humidity double, ph double, rainfall double, label string"
PRODUCTION_CSV = "State_Name string, District_Name string, Crop_Year int, Season string, Crop string, Area double, Production double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with a header, under a fixed schema.

    A line that does not fit keeps its text in ``_corrupt_record`` and has NULL
    where it could not be read; nothing is dropped."""
    return (spark.read.schema(f"{schema}, _corrupt_record string").option("header", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """S3: the cleaned table as Parquet, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report (manifest, validation checks) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
