"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lit_d(x: float) -> Column:
    """A DOUBLE literal (plain Python floats become DECIMAL in some paths)."""
    return F.lit(float(x)).cast("double")


def clamp(c: Column, lo: float, hi: float) -> Column:
    """min(max(c, lo), hi), NULL-preserving (``greatest``/``least`` skip NULLs)."""
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, lit_d(lo)), lit_d(hi)))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def right_closed_bin(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Bin label with right-closed intervals and an inclusive lowest edge.

    Out-of-range and missing values map to the string ``'nan'`` (what the
    reference stores after casting its categorical to text).
    """
    expr = None
    for i, label in enumerate(labels):
        lo, hi = lit_d(edges[i]), lit_d(edges[i + 1])
        cond = (c >= lo) & (c <= hi) if i == 0 else (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("nan"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius_km: float = 6371.0) -> Column:
    rad = math.pi / 180.0
    dlat = (lat2 - lat1) * lit_d(rad)
    dlon = (lon2 - lon1) * lit_d(rad)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(lat1 * lit_d(rad)) * F.cos(lat2 * lit_d(rad)) * F.pow(F.sin(dlon / 2), 2))
    return lit_d(radius_km) * (F.atan2(F.sqrt(a), F.sqrt(lit_d(1.0) - a)) * 2)


def month_add(m: Column, k: int) -> Column:
    """Month arithmetic on 1..12 with wrap-around (``pmod``: ``%`` keeps the sign)."""
    return F.pmod(m - 1 + F.lit(k), F.lit(12)) + 1


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI mode raises on /0)."""
    return F.try_divide(num, F.when(den != 0, den))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    A cross join with one broadcast row: the small side is a global aggregate,
    so its size is bounded and no row is multiplied.
    """
    return df.crossJoin(F.broadcast(one_row))
