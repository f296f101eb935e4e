"""Data-validation suite (A2-A10).

Three plain aggregates, each with one column-pruned scan and no expansion of
rows: null counts, range violations and extremes in one global ``agg``;
duplicates from ``groupBy(sample_id)``; locations and classes from one
``groupBy(location_id, target_crop)``, which combines map-side, so a hot class
costs nothing extra.
Results are a long table: one row per check with its numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.sources import dims

NUMERIC_TYPES = ("double", "bigint", "float")


def column_stats(df: DataFrame) -> DataFrame:
    """One-row frame of every per-column statistic the checks use."""
    aggs = [F.count("*").alias("n_rows")]
    for c in df.columns:
        aggs.append(F.count(F.col(c)).alias(f"nn__{c}"))
    types = dict(df.dtypes)
    for feat, lo, hi in dims.FEATURE_RANGES:
        if feat in df.columns and types[feat] in NUMERIC_TYPES:
            v = F.col(feat)
            aggs += [F.count_if(v < lit_d(lo)).alias(f"below__{feat}"),
                     F.count_if(v > lit_d(hi)).alias(f"above__{feat}"),
                     F.min(v).cast("double").alias(f"min__{feat}"),
                     F.max(v).cast("double").alias(f"max__{feat}")]
    return df.agg(*aggs)


def null_rates(df: DataFrame, max_null_pct: float = 0.5) -> DataFrame:
    """A4: null rate of each present required feature; fails only if > threshold."""
    feats = [c for c in dims.REQUIRED_FEATURES if c in df.columns]
    st = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in feats])
    stacked = st.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in feats])).alias("s"))
    return stacked.select("s.feature", F.round("s.null_rate", 6).alias("null_rate"),
                          (F.col("s.null_rate") <= max_null_pct).alias("passed"))


def feature_ranges(df: DataFrame) -> DataFrame:
    """A5: per checked feature: violations below/above, actual min/max."""
    st = column_stats(df)
    types = dict(df.dtypes)
    items = [F.struct(F.lit(f).alias("feature"), lit_d(lo).alias("lo"), lit_d(hi).alias("hi"),
                      F.col(f"below__{f}").alias("below_min"), F.col(f"above__{f}").alias("above_max"),
                      F.col(f"min__{f}").alias("actual_min"), F.col(f"max__{f}").alias("actual_max"))
             for f, lo, hi in dims.FEATURE_RANGES if f in df.columns and types[f] in NUMERIC_TYPES]
    return st.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def class_balance(df: DataFrame, min_samples: int = 10) -> DataFrame:
    """Classes under the minimum, smallest and largest class (NULL label excluded)."""
    counts = df.where(F.col("target_crop").isNotNull()).groupBy("target_crop").count()
    return counts.agg(F.count_if(F.col("count") < min_samples).alias("n_under"),
                      F.min("count").alias("min_samples"), F.max("count").alias("max_samples"),
                      (F.count_if(F.col("count") < min_samples) == 0).alias("passed"))


def unknown_labels(df: DataFrame) -> DataFrame:
    """Distinct labels not in the 22 known crops (anti-join on a 22-row literal)."""
    known = df.sparkSession.createDataFrame([(c,) for c in dims.CROP_LABELS], "target_crop string")
    return (df.select("target_crop").where(F.col("target_crop").isNotNull()).distinct()
            .join(F.broadcast(known), "target_crop", "left_anti"))


def validation_checks(df: DataFrame, max_null_pct: float = 0.5, min_samples: int = 10) -> DataFrame:
    """A2-A9 as one row per check: name, severity, passed, metric (a number)."""
    st = column_stats(df)
    cols = df.columns
    checks = []
    missing = [c for c in dims.REQUIRED_FEATURES if c not in cols]
    checks.append(F.struct(F.lit("required_columns_present").alias("name"), F.lit("critical").alias("severity"),
                           F.lit(len(missing) == 0).alias("passed"), lit_d(len(missing)).alias("metric")))
    all_null = sum(((F.col(f"nn__{c}") == 0).cast("int") for c in cols), F.lit(0))
    checks.append(F.struct(F.lit("no_all_null_columns").alias("name"), F.lit("warning").alias("severity"),
                           (all_null == 0).alias("passed"), all_null.cast("double").alias("metric")))
    feats = [c for c in dims.REQUIRED_FEATURES if c in cols]
    high = sum((((F.lit(1.0) - F.col(f"nn__{c}") / F.col("n_rows")) > max_null_pct).cast("int") for c in feats), F.lit(0))
    checks.append(F.struct(F.lit("null_rates_acceptable").alias("name"), F.lit("critical").alias("severity"),
                           (high == 0).alias("passed"), high.cast("double").alias("metric")))
    types = dict(df.dtypes)
    ranged = [f for f, _, _ in dims.FEATURE_RANGES if f in cols and types[f] in NUMERIC_TYPES]
    viol = sum((((F.col(f"below__{f}") + F.col(f"above__{f}")) > 0).cast("int") for f in ranged), F.lit(0))
    checks.append(F.struct(F.lit("feature_ranges_valid").alias("name"), F.lit("critical").alias("severity"),
                           (viol == 0).alias("passed"), viol.cast("double").alias("metric")))
    parts = [st.select(F.explode(F.array(*checks)).alias("c")).select("c.*")]
    if "sample_id" in cols:
        # NULL ids form one group, so they count as repeats of each other.
        ids = df.groupBy("sample_id").agg(F.count("*").alias("n"))
        dup = F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")
        parts.append(ids.agg(dup.alias("dup")).select(
            F.lit("no_duplicate_sample_ids").alias("name"), F.lit("warning").alias("severity"),
            (F.col("dup") == 0).alias("passed"), F.col("dup").cast("double").alias("metric")))
    # One combinable pass gives the counts by location and crop; the rest reads that small result.
    some = [c for c in ("location_id", "target_crop") if c in cols]
    few = df.groupBy(*some).agg(F.count("*").alias("n")) if some else None
    if "location_id" in cols:
        places = few.groupBy("location_id").agg(F.sum("n").alias("n"))
        found = places.agg(F.count("location_id").alias("d"), F.count_if(F.col("location_id").isNull()).alias("u"))
        parts.append(found.select(
            F.lit("location_ids_present").alias("name"), F.lit("critical").alias("severity"),
            ((F.col("u") == 0) & (F.col("d") >= 2)).alias("passed"), F.col("d").cast("double").alias("metric")))
    else:
        parts.append(_absent(df, "location_ids_present"))
    if "target_crop" in cols:
        counts = few.where(F.col("target_crop").isNotNull()).groupBy("target_crop").agg(F.sum("n").alias("count"))
        known = df.sparkSession.createDataFrame([(c,) for c in dims.CROP_LABELS], "target_crop string")
        flagged = counts.join(F.broadcast(known.withColumn("_known", F.lit(True))), "target_crop", "left")
        tail = flagged.agg(
            F.count_if(F.col("_known").isNull()).cast("double").alias("n_unknown"),
            F.count_if(F.col("count") < min_samples).cast("double").alias("n_under"))
        parts.append(tail.select(F.explode(F.array(
            F.struct(F.lit("target_cardinality").alias("name"), F.lit("warning").alias("severity"),
                     (F.col("n_unknown") == 0).alias("passed"), F.col("n_unknown").alias("metric")),
            F.struct(F.lit("class_balance_minimum").alias("name"), F.lit("warning").alias("severity"),
                     (F.col("n_under") == 0).alias("passed"), F.col("n_under").alias("metric")))).alias("c")).select("c.*"))
    else:
        parts.append(_absent(df, "target_cardinality"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _absent(df: DataFrame, name: str) -> DataFrame:
    """A check whose column the table does not have: a critical failure."""
    return df.sparkSession.createDataFrame([(name, "critical", False, 0.0)], "name string, severity string, passed boolean, metric double")


def validation_report(checks: DataFrame) -> DataFrame:
    """A10: roll-up; FAIL iff any critical check failed."""
    crit = F.count_if(~F.col("passed") & (F.col("severity") == "critical"))
    return checks.agg(F.count("*").alias("total_checks"), F.count_if("passed").alias("passed"),
                      crit.alias("critical_failures"),
                      F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warnings"),
                      F.when(crit == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("overall_status"))
