"""Exact ranks over a whole column without sorting it in one task."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.session import durable


def value_ranks(values: DataFrame, column: str, weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """(value, below, upto, total) per distinct value, counting rows or weights.

    Equal values collapse first. Distinct values are spread over ranges cut at
    approximate quantiles; one row per range carries the counts before it. The cuts
    only balance the work, the ranks are exact. There are as many ranges as shuffle
    partitions unless `ranges` says otherwise.
    """
    ranges = ranges or max(2, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = values.groupBy(F.col(column).alias("value")).agg(
        F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("n"))
    cuts = values.agg(F.array_distinct(F.percentile_approx(column, [i / ranges for i in range(1, ranges)])))
    part = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col("value"))), F.lit(0))
    # Stored, since the counts before each range and the ranks inside it both start from it.
    placed = durable(counts.withColumn("_cuts", cuts.scalar()).withColumn("_part", part).drop("_cuts"))
    totals = placed.groupBy("_part").agg(F.sum("n").alias("_n"))
    # At most ranges + 1 rows take part in this window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(everything).alias("total"))
    inside = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.join(offsets, "_part").withColumn("upto", F.sum("n").over(inside) + F.col("_offset"))
            .select("value", (F.col("upto") - F.col("n")).alias("below"), "upto", "total"))


def midrank(scores: DataFrame, calibration: DataFrame, column: str, name: str = "anomaly_percentile") -> DataFrame:
    """Scores with their midrank empirical CDF against a frozen calibration sample."""
    pool = (calibration.select(column, F.lit(1).alias("_weight"))
            .unionByName(scores.select(column, F.lit(0).alias("_weight")).where(F.col(column).isNotNull())))
    ranks = value_ranks(pool, column, F.col("_weight"))
    return (scores.join(ranks.withColumnRenamed("value", column), column, "left")
            .withColumn(name, (F.col("below") + F.col("upto")) / (2 * F.col("total"))).drop("below", "upto", "total"))


def quantile_higher(values: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the element at 0-based position ceil(q * (n - 1)) of the sorted column."""
    ranks = value_ranks(values, column)
    return ranks.where(F.col("upto") > F.ceil(F.lit(q) * (F.col("total") - 1))).agg(F.min("value").alias("quantile"))
