"""Shared inputs for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.operators.ingest import to_canonical
from agrolens.sources import fixtures

AS_OF = "2025-01-15"  # fixed clock for every date-dependent query


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical samples (renamed, normalised crop) from FX1."""
    raw = fixtures.soil_samples(spark, sf_dir)
    return to_canonical(raw).withColumnsRenamed(
        {"sample_date": "date", "lat": "latitude", "lon": "longitude"})


# DuckDB twin of ``samples`` (rename + normalise), on top of the FX1 CTE.
SAMPLES_SQL = """samples AS (
  SELECT sample_id, row_uid, sample_date AS date, location_id,
         lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')) AS target_crop,
         N AS N_kg_ha, P AS P_kg_ha, K AS K_kg_ha, temperature AS avg_temp_c,
         humidity AS humidity_pct, ph AS pH, rainfall AS avg_precip_mm,
         lat AS latitude, lon AS longitude
  FROM soil_samples
)"""


def d(x: float) -> str:
    """DOUBLE literal for oracle SQL."""
    return f"CAST({x!r} AS DOUBLE)"


def rsql(expr: str, n: int) -> str:
    """Oracle rounding that matches Spark's ``round``: HALF_UP on the shortest
    decimal text of the double (DuckDB's own ``ROUND`` on DOUBLE is not
    correctly rounded near .5 boundaries)."""
    return f"CAST(ROUND(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,17)), {n}) AS DOUBLE)"


def rnd(c, n: int = 6):
    return F.round(c, n)
