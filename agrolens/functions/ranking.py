"""Global row numbers without a window over all rows."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolens.session import shared_dir


def group_row_number(groups: DataFrame, order_cols: list, alias: str = "rn", parts: int | None = None) -> DataFrame:
    """Adds ``alias`` = 1-based rank by ``order_cols`` (must be a total order).

    The rows are cut into ranges of that order and written with their range (the
    bounds are sampled, so they are kept, not made again).  A rank is the place
    within the range plus the rows of the ranges before, of which there
    are ``parts`` counts.  ``groups`` must not have a column ``_range``.
    """
    spark = groups.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark, f"ranges-{uuid.uuid4().hex}")
    groups.repartitionByRange(parts, *order_cols).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # a row a range
    before = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(i, b) for (i, _), b in zip(counts, before)], "_range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(alias, place + F.col("_before")).drop("_range", "_before")
