"""ETL: rename, normalise, align, stamp, yield, per-crop medians, manifest."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d, with_scalars
from agrolens.functions.joins import join_small
from agrolens.functions.percentiles import exact_median
from agrolens.sources import dims


def rename_columns(df: DataFrame, source: str = "crop_recommendation") -> DataFrame:
    """Rename source columns to canonical names; absent columns are ignored."""
    mapping = {k: v for k, v in dims.RENAME_MAPS[source].items() if k in df.columns}
    return df.withColumnsRenamed(mapping)


def normalize_crop(c: Column) -> Column:
    """Lower-case and strip surrounding whitespace (NULL stays NULL)."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def to_canonical(raw: DataFrame) -> DataFrame:
    """P1 + P2 for the raw crop-sample schema."""
    df = rename_columns(raw, "crop_recommendation")
    if "target_crop" in df.columns:
        df = df.withColumn("target_crop", normalize_crop(F.col("target_crop")))
    return df


def align_canonical(df: DataFrame) -> DataFrame:
    """The 27 canonical columns in order, absent ones as typed NULLs."""
    cols = []
    for name, typ in dims.CANONICAL_COLUMNS:
        if name in df.columns:
            cols.append(F.col(name).cast(typ).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return df.select(*cols)


def stamp_samples(df: DataFrame, key_cols: list[str], as_of: str,
                  label_source: str = "kaggle_expert_recommendation") -> DataFrame:
    """Deterministic sample id of 16 hex digits (8 would repeat at some 100,000 rows), load date (a parameter), source literal."""
    return df.withColumns({
        "sample_id": F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]), 256), 1, 16),
        "date": F.lit(_dt.date.fromisoformat(as_of)),
        "label_source": F.lit(label_source),
    })


def compute_yield(df: DataFrame) -> DataFrame:
    """P5: yield kg/ha = production * 1000 / area when area > 0, else NULL."""
    if "production_tonnes" not in df.columns or "area_ha" not in df.columns:
        return df
    return df.withColumn(
        "yield_kg_ha",
        F.when(F.col("area_ha") > 0, F.col("production_tonnes") * lit_d(1000.0) / F.col("area_ha")))


def production_canonical(raw: DataFrame) -> DataFrame:
    """Raw production rows -> canonical names, normalised crop, yield."""
    df = rename_columns(raw, "crop_production")
    df = df.withColumn("target_crop", normalize_crop(F.col("target_crop")))
    return compute_yield(df)


def yield_median_by_crop(production: DataFrame, approx: bool = False) -> DataFrame:
    """A1 + F1: exact median yield per crop; NULL crops / yields dropped.

    Uses the skew-safe distributed percentile (a crop may hold a third of
    the rows); ``approx=True`` uses a mergeable sketch instead.
    """
    x = production.where(F.col("target_crop").isNotNull() & F.col("yield_kg_ha").isNotNull())
    return exact_median(x, ["target_crop"], "yield_kg_ha", alias="yield_kg_ha_median", approx=approx) \
        .select("target_crop", F.col("n").alias("n_records"), "yield_kg_ha_median")


def merge_median_yield(samples: DataFrame, medians: DataFrame) -> DataFrame:
    """Left-join per-crop medians and fill missing yields.

    The median table has one row per distinct crop and is broadcast up to a
    stated size; beyond it the join is salted, so a hot crop is spread.
    """
    out = join_small(samples, medians.select("target_crop", "yield_kg_ha_median"), "target_crop", "left")
    if "yield_kg_ha" in samples.columns:
        out = out.withColumn("yield_kg_ha", F.coalesce(F.col("yield_kg_ha"), F.col("yield_kg_ha_median")))
    else:
        out = out.withColumn("yield_kg_ha", F.col("yield_kg_ha_median"))
    return out.drop("yield_kg_ha_median")


def crop_counts(df: DataFrame) -> DataFrame:
    """Samples per crop (partial aggregation handles a hot crop)."""
    return df.groupBy("target_crop").agg(F.count("*").alias("n_samples"))


def run_manifest(df: DataFrame) -> DataFrame:
    """S5 + A11: one-row manifest of the cleaned table.

    Rows combine to one a (crop, location) first, so the distinct counts and
    the crop list are taken over those few.
    """
    few = df.groupBy("target_crop", "location_id").agg(F.count("*").alias("n"), F.count("yield_kg_ha").alias("y"))
    return few.agg(
        F.sum("n").alias("num_samples"),
        F.lit(len(df.columns)).cast("bigint").alias("num_features"),
        F.countDistinct("target_crop").alias("num_crops"),
        F.countDistinct("location_id").alias("num_locations"),
        F.array_join(F.sort_array(F.collect_set("target_crop")), ",").alias("crops"),
        F.round(F.sum("y") / F.sum("n"), 6).alias("yield_coverage"),
    )


def table_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-insensitive content checksum.

    Per row: sha2 of the row's text form (numbers as decimals of six places,
    missing values as ``~``, joined by ``|``); the first 15 hex digits (60 bits)
    are summed modulo 2^60 over all rows, so the result is independent of
    partitioning and order, and merges map-side.
    """
    cols = cols or df.columns
    types = dict(df.dtypes)
    text = {c: F.col(c).cast("decimal(30,6)").cast("string") if types[c] in ("double", "float") else F.col(c).cast("string") for c in cols}
    row_text = F.concat_ws("|", *[F.coalesce(text[c], F.lit("~")) for c in cols])
    h = F.conv(F.substring(F.sha2(row_text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("num_rows"),
                  F.pmod(F.sum(h), F.lit(2 ** 60).cast("decimal(20,0)")).cast("bigint").alias("fingerprint"))


def zscore_features(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Fill NULLs with the column median, then z-score (sample std, +1e-8).

    Mean/std come from one aggregation; medians from the distributed exact
    percentile (a whole column is one group here).  One-row stats frames
    are attached by a cross join with one broadcast row.
    """
    cols = cols or ["avg_temp_c", "humidity_pct", "avg_precip_mm", "pH"]
    # One percentile run keyed by the column's name serves all columns.
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")).select("s.*")
    each = exact_median(long, ["column"], "v", alias="m", approx=approx)
    meds = each.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"_med_{c}") for c in cols])
    filled = with_scalars(df, meds).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols})
    stats = filled.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                       *[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols])
    out = with_scalars(filled, stats)
    out = out.withColumns({f"{c}_z": (F.col(c) - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + lit_d(1e-8))
                           for c in cols})
    return out.drop(*[f"_med_{c}" for c in cols], *[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])
