"""Chart tables. Their input is a bucket table ``(key, n)`` already cut to size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec


def _all() -> WindowSpec:
    return W.partitionBy()


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("decimal(20,0)") / whole.cast("decimal(20,0)")


def share_of_total(buckets: DataFrame) -> DataFrame:
    """Pie: percentage of the sum, one decimal, and a bar of up to 20 cells."""
    share = _ratio(F.col("n"), F.sum("n").over(_all()))
    return buckets.select(
        "key",
        "n",
        F.round(share * 100, 1).cast("double").alias("percent"),
        F.floor(share * 20 + F.lit(0.5).cast("decimal(2,1)")).cast("int").alias("bar"),
    )


def percent_of_max(buckets: DataFrame, width: int = 50) -> DataFrame:
    """Bars: percentage of the largest bucket, one decimal, and the bar length."""
    share = _ratio(F.col("n"), F.max("n").over(_all()))
    return buckets.select(
        "key",
        "n",
        F.round(share * 100, 1).cast("double").alias("percent"),
        F.floor(share * width + F.lit(0.5).cast("decimal(2,1)")).cast("int").alias("bar"),
    )


# The five bands and their colours.
HEAT_BANDS = [(80, "#FF0000"), (60, "#FF6600"), (40, "#FFCC00"), (20, "#99FF00")]
COOLEST = "#00FF00"


def heat_bands(buckets: DataFrame) -> DataFrame:
    """Heat: value normalised to the maximum, and its colour band."""
    value = _ratio(F.col("n"), F.max("n").over(_all())) * 100
    band = None
    for above, colour in HEAT_BANDS:
        cond = value > above
        band = F.when(cond, colour) if band is None else band.when(cond, colour)
    return buckets.select(
        "key",
        "n",
        F.round(value, 6).cast("double").alias("normalized"),
        band.otherwise(COOLEST).alias("band"),
    )
