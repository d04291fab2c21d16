"""Range joins: moments to the intervals that hold them, such as signatures to the certificates in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(day: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")


def in_force(moments: DataFrame, ranges: DataFrame, on: list[str], at: Column, low: Column, high: Column, width: int) -> DataFrame:
    """moments joined to the ranges with equal `on` columns whose low <= at <= high; a row for each pair.

    at, low and high are whole numbers. Both sides are cut into buckets of `width`, so they meet by equality and a key with many ranges and moments isn't
    compared all with all; a range is repeated once for each bucket that it touches, so width should be near a usual range's length. A range that ends before
    it begins, and nulls, meet nothing. Apart from `on`, names of the two sides must differ.
    """
    bucket = lambda n: F.floor(n / width).cast("long")
    known = ranges.where(low <= high).withColumns({"_low": low, "_high": high})
    known = known.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))))
    placed = moments.withColumn("_at", at).withColumn("_bucket", bucket(F.col("_at")))
    return placed.join(known, [*on, "_bucket"]).where("_at between _low and _high").drop("_bucket", "_at", "_low", "_high")
