"""Exact percentiles that never gather one group into one task.

``F.median``/``percentile`` keep every distinct value of a group in a single
aggregation buffer, so one hot group (say a crop holding a third of all rows)
ends up in one task's memory.  Here ranks are found by counting:

1. ``(keys, value) -> count`` combines map-side, so a value that most rows
   share is one row a task from there on.
2. Each value falls into an ordered bucket, a fixed monotone function of the
   value (256 to each power of two).  Bucket totals per group are prefix-summed;
   a group has at most a few thousand of them however many rows it holds.
3. The buckets that hold a needed rank (at most two per probability) are
   opened, and their values' counts are prefix-summed.  The result is the
   numpy/DuckDB "linear" interpolation ``lo + (hi - lo) * frac``.

Every step is a function of the data alone, so the answer does not depend on
whether an exchange is reused or a task runs again.

``approx=True`` swaps in ``percentile_approx`` (a mergeable sketch with
map-side partial aggregation) when an approximate answer is acceptable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_bucket(v: Column) -> Column:
    """A long that never falls as ``v`` grows."""
    size = F.floor(F.log2(F.abs(v)) * 256) + 300_000
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                      approx: bool = False, prefix: str = "p") -> DataFrame:
    """One row per group: ``keys`` + ``n`` + one column per probability.

    Column names are ``f"{prefix}{int(round(p*100))}"`` (e.g. p50, p95).
    NULL values are ignored; groups whose values are all NULL are dropped.
    """
    names = [f"{prefix}{int(round(p * 100))}" for p in probs]
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if approx:
        aggs = [F.percentile_approx("_v", F.lit(p), 100000).alias(n) for p, n in zip(probs, names)]
        g = x.groupBy(*keys) if keys else x.groupBy()
        return g.agg(F.count("*").alias("n"), *aggs)

    counts = x.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).withColumn("_b", ordered_bucket(F.col("_v")))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = totals.withColumns({
        "_off": F.sum("_t").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t"),
        "n": F.sum("_t").over(group)})
    # Needed ranks per group and probability: floor and ceiling of p * (n - 1).
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    need = totals.select("*", F.explode(wanted).alias("q")).withColumn("_at", F.col("q.p") * (F.col("n") - 1))
    need = need.select(*keys, "_b", "_off", "_t", "n", F.col("q.i").alias("_qi"),
                       (F.col("_at") - F.floor("_at")).alias("_frac"),
                       F.explode(F.array(F.floor("_at").cast("bigint"), F.ceil("_at").cast("bigint"))).alias("_r"))
    need = need.where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_t"))).distinct()
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    opened = counts.join(need.select(*keys, "_b").distinct(), [*keys, "_b"]).withColumn("_upto", F.sum("_c").over(inside))
    picked = opened.join(need, [*keys, "_b"]).where(
        (F.col("_r") < F.col("_off") + F.col("_upto")) & (F.col("_r") >= F.col("_off") + F.col("_upto") - F.col("_c")))
    vals = picked.groupBy(*keys, "_qi").agg(F.max("n").alias("n"), F.max("_frac").alias("_frac"),
                                            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    vals = vals.withColumn("_val", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    out = vals.groupBy(*keys) if keys else vals.groupBy()
    return out.agg(F.max("n").alias("n"),
                   *[F.max(F.when(F.col("_qi") == i, F.col("_val"))).alias(nm) for i, nm in enumerate(names)])


def exact_median(df: DataFrame, keys: list[str], value: str, alias: str = "median",
                 approx: bool = False) -> DataFrame:
    out = exact_percentiles(df, keys, value, [0.5], approx=approx, prefix="_m")
    return out.select(*keys, "n", F.col("_m50").alias(alias))
