"""Ordering, pages and first rows per key."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[str | Column], limit: int, cursor: int = 0) -> DataFrame:
    """Rows cursor .. cursor + limit in order, with the total and the next cursor.

    The sort keeps the page's rows only (top-k per task); deep pages should use `after`.
    """
    total = rows.agg(F.count("*"))
    following = F.lit(cursor + limit)
    return (rows.orderBy(*order).offset(cursor).limit(limit).withColumn("total", total.scalar())
            .withColumn("next_cursor", F.when(following < F.col("total"), following)))


def after(rows: DataFrame, order: list[str], last: tuple, limit: int) -> DataFrame:
    """The page following a known last row: a filter instead of an offset."""
    beyond = F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType) for c, v in zip(order, last)])
    return rows.where(beyond).orderBy(*order).limit(limit)


def first_k(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows per key. Spark limits each task to k rows per key before the shuffle."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(line)).where(F.col("_rank") <= k).drop("_rank")


def recent_runs(runs: DataFrame, dataset: str, limit: int = 200) -> DataFrame:
    return runs.where(F.col("dataset_id") == dataset).orderBy(F.desc("created"), "analysis_run_id").limit(limit)
