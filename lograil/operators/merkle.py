"""Tamper-evident identity of a set of rows: a tree of SHA-256 over ranges of row hashes."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions.identity import record_sha256
from lograil.session import durable

DEPTH = 6       # hexadecimal digits of a leaf's range: sixteen million ranges
STEP = 2        # digits from level to level


def _joined(lines: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), "|"), 256)


def tree(rows: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """(level, range, sha256, rows): the nodes of the tree over `columns` of all rows; levels are digits of the range.

    Equal rows are counted before anything is gathered, so a leaf holds the distinct row hashes of its
    range with their counts, in order; a node above holds the hashes of at most 256 ranges. The root
    has level 0 and the empty range. Order and partitions of the rows change nothing; an empty table has no nodes.
    """
    counted = rows.select(record_sha256(columns).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    level = durable(counted.groupBy(F.substring("row", 1, depth).alias("range")).agg(
        _joined(F.concat_ws(":", "row", "n")).alias("sha256"), F.sum("n").alias("rows")).withColumn("level", F.lit(depth)))
    nodes = level
    for length in reversed(range(0, depth, STEP)):
        level = level.groupBy(F.substring("range", 1, length).alias("range")).agg(
            _joined(F.concat_ws(":", "range", "sha256")).alias("sha256"), F.sum("rows").alias("rows")).withColumn("level", F.lit(length))
        nodes = nodes.unionByName(level)
    return nodes.select("level", "range", "sha256", "rows")


def root(nodes: DataFrame) -> DataFrame:
    """One row: fingerprint and event_count; the fingerprint of no rows is that of an empty text."""
    return nodes.where("level = 0").agg(F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("fingerprint"), F.coalesce(F.sum("rows"), F.lit(0)).alias("event_count"))


def fingerprint(rows: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """One row identifying a set of rows, whatever its order or partitioning: fingerprint and event_count."""
    return root(tree(rows, columns, depth))


def changed_ranges(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(range, left_rows, right_rows) of the leaves in which two stored trees of one depth differ.

    Levels are compared from the root down, and below equal nodes nothing is read.
    """
    parents = None
    for level in [*range(0, depth, STEP), depth]:
        sides = [nodes.where(F.col("level") == level).select("range", F.col("sha256").alias(f"{name}_sha256"), F.col("rows").alias(f"{name}_rows"))
                 for nodes, name in ((left, "left"), (right, "right"))]
        if parents is not None:
            above = F.substring("range", 1, max(n for n in range(0, depth, STEP) if n < level))
            sides = [s.withColumn("parent", above).join(parents, "parent", "left_semi").drop("parent") for s in sides]
        both = sides[0].join(sides[1], "range", "full_outer").where(~F.col("left_sha256").eqNullSafe(F.col("right_sha256")))
        both = durable(both.select("range", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows")))
        parents = both.select(F.col("range").alias("parent"))
    return both


def changed_rows(left: DataFrame, right: DataFrame, ranges: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """(row, left_n, right_n): row hashes in changed ranges that the two sides do not hold equally often."""
    sides = []
    for rows, name in ((left, "left_n"), (right, "right_n")):
        digests = rows.select(record_sha256(columns).alias("row")).withColumn("range", F.substring("row", 1, depth))
        sides.append(digests.join(ranges.select("range"), "range", "left_semi").groupBy("row").agg(F.count("*").alias(name)))
    both = sides[0].join(sides[1], "row", "full_outer").na.fill(0, ["left_n", "right_n"])
    return both.where("left_n <> right_n")
