"""Ratios and intervals that stay null on an empty denominator."""
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """struct(low, high): Wilson score interval clamped to [0, 1]."""
    n = F.when(total != 0, total.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))
