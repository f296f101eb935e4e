"""Operators the reference documents but does not implement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.functions.joins import join_small
from agrolens.functions.percentiles import exact_median
from agrolens.functions.ranking import group_row_number
from agrolens.sources import dims


def grid_location_id(df: DataFrame, cell_deg: float = 0.045) -> DataFrame:
    """Privacy grid (~5 km): floor(lat / cell), floor(lon / cell) and a hashed id."""
    gy = F.floor(F.col("latitude") / lit_d(cell_deg))
    gx = F.floor(F.col("longitude") / lit_d(cell_deg))
    return df.withColumns({"grid_y": gy, "grid_x": gx,
                           "grid_id": F.substring(F.sha2(F.concat_ws(":", gy.cast("string"), gx.cast("string")), 256), 1, 16)})


def pseudonymize(df: DataFrame, id_col: str, salt: str, drop: list[str]) -> DataFrame:
    """Salted participant id replaces the raw id; identifying columns dropped."""
    pid = F.sha2(F.concat(F.lit(salt), F.lit("|"), F.col(id_col).cast("string")), 256)
    return df.withColumn("participant_id", pid).drop(id_col, *drop)


def k_anonymous_counts(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Aggregate-only output, groups smaller than k suppressed."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= k)


def outlier_filter(df: DataFrame, key: str, value: str, z: float = 3.0) -> DataFrame:
    """Keep rows within median +- z * 1.4826 * MAD of their group (exact,
    skew-safe medians; two passes: the median, then the median absolute
    deviation).  NULL values are kept out."""
    v = df.where(F.col(value).isNotNull())
    med = exact_median(v, [key], value, alias="_med").select(key, "_med")
    dev = join_small(v, med, key).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = exact_median(dev, [key], "_dev", alias="_mad").select(key, "_mad")
    j = join_small(dev, mad, key)
    band = lit_d(z * 1.4826) * F.col("_mad")
    return j.where(F.abs(F.col(value) - F.col("_med")) <= band).drop("_med", "_dev", "_mad")


def psi(df: DataFrame, is_reference, bin_col: str, eps: float = 1e-6) -> DataFrame:
    """Population stability index and KL divergence between the bin
    distributions of the reference rows and the others (epsilon for empty bins).

    One scan: both counts come from one conditional aggregate by bin, and the
    totals are sums over the bins."""
    bins = df.groupBy(bin_col).agg(F.count_if(is_reference).alias("_p"), F.count_if(~is_reference).alias("_q"))
    tot = bins.agg(F.sum("_p").alias("_pt"), F.sum("_q").alias("_qt"))
    j = bins.crossJoin(F.broadcast(tot))  # one row
    p = F.col("_p") / F.col("_pt") + lit_d(eps)
    q = F.col("_q") / F.col("_qt") + lit_d(eps)
    return j.agg(F.round(F.sum((q - p) * F.log(q / p)), 6).alias("psi"),
                 F.round(F.sum(p * F.log(p / q)), 6).alias("kl"))


def economic_rank(recommended: DataFrame, prices: DataFrame) -> DataFrame:
    """Rank a location's recommended crops by probability x yield (quintals) x price a quintal.

    ``prices`` has one row a (state, crop); a crop without a price ranks last."""
    value = F.col("probability") * F.col("expected_yield_kg_ha") / lit_d(100.0) * F.col("price")
    x = recommended.join(prices, ["state", "crop"], "left").withColumn("economic_value", F.round(value, 2))
    order = Window.partitionBy("location_id").orderBy(F.col("economic_value").desc_nulls_last(), "rank")  # a few rows a location
    return x.withColumn("economic_rank", F.row_number().over(order))


def season_amplitude(measures: DataFrame, keys: list[str]) -> DataFrame:
    """D3: greatest less least of the valid (positive) values."""
    return measures.where("value > 0").groupBy(*keys).agg((F.max("value") - F.min("value")).alias("amplitude"))


def moisture_index(df: DataFrame, precip: str = "precip", pet: str = "pet") -> DataFrame:
    """Precipitation less evapotranspiration, which is an input column."""
    return df.withColumn("moisture_index", F.col(precip) - F.col(pet))


def impute_layered(df: DataFrame, district: str = "district") -> DataFrame:
    """The lab value, else the modelled one, else the district's median lab value."""
    med = exact_median(df.where(F.col("lab").isNotNull() & F.col(district).isNotNull()), [district], "lab", alias="_med").select(district, "_med")
    x = join_small(df, med, district, "left")
    source = F.when(F.col("lab").isNotNull(), "lab").when(F.col("modelled").isNotNull(), "modelled").when(F.col("_med").isNotNull(), "district")
    return x.withColumns({"value": F.coalesce("lab", "modelled", "_med"), "source": source}).drop("_med")


def majority_vote(votes: DataFrame, key: str) -> DataFrame:
    """The label most reviewers gave (ties: first by name), its votes, the share that agree,
    and whether two or more do."""
    each = votes.groupBy(key, "label").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("all")).select(
        key, F.col("b.label").alias("label"), (-F.col("b.m")).alias("votes"), F.round(-F.col("b.m") / F.col("all"), 4).alias("agreement"),
        (-F.col("b.m") >= 2).alias("accepted"))


def alternative_features(df: DataFrame) -> DataFrame:
    """Ratios over max(denominator, 1), a four-level pH bin and season indicators."""
    ph = F.when(F.col("pH") < 5.5, "acidic").when(F.col("pH") < 6.5, "slightly_acidic").when(F.col("pH") <= 7.5, "neutral").when(F.col("pH") > 7.5, "alkaline")
    month = F.month("date")
    seasons = {s: (month.between(a, b) if a <= b else (month >= a) | (month <= b)) for s, a, b in dims.SEASON_MONTHS}

    def at_least_one(c):
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c), lit_d(1.0)))
    return df.withColumns({"NP_ratio": F.col("N_kg_ha") / at_least_one("P_kg_ha"), "NK_ratio": F.col("N_kg_ha") / at_least_one("K_kg_ha"), "pH_level": ph,
                           **{f"season_{s.lower()}": F.coalesce(c.cast("int"), F.lit(0)) for s, c in seasons.items()}})


def stratified_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Whole groups dealt into ``k`` folds, within the label that most of a group's rows have.

    Ranked are groups, by a seeded hash, not rows; the rank within a stratum is the global
    rank past the stratum's first."""
    each = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    main = each.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b")).select(group, F.col("b.l").alias("stratum"))
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256)
    ranked = group_row_number(main.withColumn("_h", h), ["stratum", "_h", group], "_rn")
    first = ranked.groupBy("stratum").agg(F.min("_rn").alias("_first"))
    return join_small(ranked, first, "stratum").select(group, "stratum", F.pmod(F.col("_rn") - F.col("_first"), F.lit(k)).cast("int").alias("fold"))
