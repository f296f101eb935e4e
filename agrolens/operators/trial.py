"""Field trial: assignment of clusters within strata, and effects with cluster-robust intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.functions.joins import join_small
from agrolens.functions.ranking import group_row_number

#: Two-sided 95 % of the normal distribution.
Z95 = 1.96


def assign(clusters: DataFrame, cluster: str, strata: list[str], seed: int = 42) -> DataFrame:
    """(cluster, strata, arm): clusters in the order of a seeded hash alternate between the arms within
    each stratum, 1:1 (an odd one more is treated).  Whole clusters, so farms do not influence each other across arms."""
    each = clusters.select(cluster, *strata).distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(cluster).cast("string")), 256))
    ranked = group_row_number(each, [*strata, "_h", cluster], "_rn")
    first = ranked.groupBy(*strata).agg(F.min("_rn").alias("_first"))
    odd = F.pmod(F.col("_rn") - F.col("_first"), F.lit(2)) == 0
    return join_small(ranked, first, strata).select(cluster, *strata, F.when(odd, F.lit("treatment")).otherwise(F.lit("control")).alias("arm"))


def effects(outcomes: DataFrame, assignment: DataFrame, cluster: str, measures: dict[str, F.Column]) -> DataFrame:
    """One row a measure: both arms' means, their difference, and its cluster-robust 95 % interval.

    An arm's mean is sum / count over its rows with a value; its variance is G / (G - 1) * sum over its G clusters of
    (cluster sum - cluster count * mean)^2 / count^2, so rows of a cluster need not be independent.
    Rows collapse to one a cluster and measure before anything is compared; an arm of one cluster has no interval.
    """
    x = join_small(outcomes, assignment.select(cluster, "arm"), cluster)
    sums = [F.struct(F.lit(m).alias("measure"), F.sum(c.cast("double")).alias("s"), F.count(c).alias("n")) for m, c in measures.items()]
    by_cluster = x.groupBy("arm", cluster).agg(F.array(*sums).alias("m")).select("arm", cluster, F.inline("m")).where("n > 0")
    arms = by_cluster.groupBy("measure", "arm").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("rows"))  # two a measure
    spread = by_cluster.join(F.broadcast(arms), ["measure", "arm"]).withColumn("r", F.col("s") - F.col("n") * F.col("mean"))
    g = F.count("*")
    per = spread.groupBy("measure", "arm").agg(F.max("mean").alias("mean"), F.max("rows").alias("rows"), g.alias("clusters"),
                                               (F.try_divide(g, g - 1) * F.sum(F.col("r") * F.col("r")) / F.max(F.col("rows").cast("double") * F.col("rows"))).alias("var"))

    def of(arm: str, col: str):
        return F.max(F.when(F.col("arm") == arm, F.col(col)))

    out = per.groupBy("measure").agg(*[of(a, c).alias(f"{a}_{c}") for a in ("treatment", "control") for c in ("mean", "rows", "clusters", "var")])
    diff, se = F.col("treatment_mean") - F.col("control_mean"), F.sqrt(F.col("treatment_var") + F.col("control_var"))
    return out.select("measure", *[F.round(f"{a}_mean", 4).alias(f"{a}_mean") for a in ("treatment", "control")], *[f"{a}_{c}" for a in ("treatment", "control") for c in ("rows", "clusters")],
                      F.round(diff, 4).alias("difference"), F.round(diff - lit_d(Z95) * se, 4).alias("ci_low"), F.round(diff + lit_d(Z95) * se, 4).alias("ci_high"))
