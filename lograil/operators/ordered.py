"""Nearest-event operators that never gather a whole key in one task.

Every operator here unions probes with marks, cuts the time line of a key into
cells and runs a running aggregate inside each (key, cell). A key holding a
third of all rows is therefore spread over as many tasks as it has cells, and
no pair of rows is ever produced.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
DAY = 86_400_000_000


def micros(column="event_time") -> Column:
    return F.unix_micros(F.col(column))


def utc_day(us) -> Column:
    """Whole UTC days since the epoch, correct before 1970 as well."""
    us = F.col(us) if isinstance(us, str) else us
    return F.floor(us / F.lit(DAY)).cast("bigint")


def utc_hour(us) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.floor(F.pmod(us, F.lit(DAY)) / F.lit(60 * MINUTE)).cast("int")


def _cell(position: str, width: int) -> str:
    return f"cast(floor(({position}) / {width}) as bigint)"


def _position(at: str, forward: bool) -> str:
    # Looking forward is looking back on the mirrored time line.
    return f"cast(-{at} as bigint)" if forward else f"cast({at} as bigint)"


def _with_keys(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Marks of which no key is null; as in a join, a null key meets nothing."""
    return marks.where(" and ".join(f"{k} is not null" for k in keys))


def _running(pick: str, values: list[str], keys: list[str]) -> list[str]:
    line = (f"over (partition by {', '.join(keys)}, _cell order by _pos, _side "
            "rows between unbounded preceding and current row)")
    return [f"{pick}({v}) {line} as {v}" for v in values]


def nearest_within(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, values: list[str],
                   horizon: int, *, forward=False, inclusive=False) -> DataFrame:
    """Attach the nearest mark at most `horizon` microseconds away.

    Looking back each value is the maximum over marks before the probe, looking
    forward the minimum over marks after it; `values` are structs led by what
    decides. Cells are as long as the horizon, so each mark is copied to its own
    and the following cell: one shuffle, no join.
    The caller must still reject a value beyond its horizon.
    """
    pos, side = _position(at, forward), 1 if inclusive else 0
    cell = _cell(pos, horizon)
    left = probes.selectExpr("*", f"{pos} as _pos", f"{side} as _side", f"{cell} as _cell")
    right = _with_keys(marks, keys).selectExpr(*keys, f"{pos} as _pos", *values, f"{1 - side} as _side",
                             f"explode(array({cell}, {cell} + 1)) as _cell")
    rows = left.unionByName(right, allowMissingColumns=True).selectExpr(
        *probes.columns, "_side", *_running("min" if forward else "max", values, [*keys]))
    return rows.where(f"_side = {side}").drop("_side")


def nearest(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, values: list[str],
            *, forward=False, inclusive=False, cell=15 * MINUTE, pick: str | None = None) -> DataFrame:
    """`nearest_within` without a horizon; `pick` may be sum for running totals.

    A first pass reduces each (key, cell) to one row; its running extreme over
    earlier cells enters the second pass as one extra mark at the cell's start.
    """
    pick = pick or ("min" if forward else "max")
    pos, side = _position(at, forward), 1 if inclusive else 0
    placed = [f"{pos} as _pos", f"{_cell(pos, cell)} as _cell"]
    left = probes.selectExpr("*", *placed, f"{side} as _side")
    right = _with_keys(marks, keys).selectExpr(*keys, *placed, *values, f"{1 - side} as _side")
    rows = left.unionByName(right, allowMissingColumns=True)
    cells = rows.groupBy(*keys, "_cell").agg(*[F.expr(f"{pick}({v}) as {v}") for v in values])
    before = f"over (partition by {', '.join(keys)} order by _cell rows between unbounded preceding and 1 preceding)"
    carried = cells.selectExpr(*keys, "_cell", *[f"{pick}({v}) {before} as {v}" for v in values],
                               f"_cell * {cell} as _pos", "-1 as _side")
    carried = carried.where(" or ".join(f"{v} is not null" for v in values))
    return (rows.unionByName(carried, allowMissingColumns=True)
            .selectExpr(*probes.columns, "_side", *_running(pick, values, keys))
            .where(f"_side = {side}").drop("_side"))


def count_within(probes: DataFrame, marks: DataFrame, keys: list[str], identity: str, at: str,
                 horizon: int, name: str) -> DataFrame:
    """Per probe id, the number of marks in (at, at + horizon].

    A difference of two running counts: each probe enters at both ends of its
    range, each mark in every cell whose running count can need it.
    """
    ends = F.array(F.struct(F.lit(-1).alias("sign"), F.col(at).alias("pos")),
                   F.struct(F.lit(1).alias("sign"), (F.col(at) + F.lit(horizon)).alias("pos")))
    # Both ends of one probe are counted from the start of the cell of `at`.
    left = (probes.select(*keys, identity, F.expr(_cell(at, horizon)).alias("_cell"), F.inline(ends))
            .select(*keys, identity, "_cell", "sign", "pos", F.lit(1).alias("_side"), F.lit(0).alias("_one")))
    right = (_with_keys(marks, keys).select(*keys, F.col(at).alias("pos"), F.lit(0).alias("_side"), F.lit(1).alias("_one"))
             .selectExpr("*", f"explode(array({_cell('pos', horizon)}, {_cell('pos', horizon)} - 1)) as _cell"))
    line = (Window.partitionBy(*keys, "_cell").orderBy("pos", "_side")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (left.unionByName(right, allowMissingColumns=True).withColumn("_n", F.sum("_one").over(line))
            .where("_side = 1").groupBy(identity).agg(F.sum(F.col("sign") * F.col("_n")).alias(name)))


def active_intervals(probes: DataFrame, intervals: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Number of half-open intervals [from_us, until_us) of the same key covering each probe.

    Opened so far minus closed so far: overlapping intervals of a hot key are
    never paired with the probes they cover.
    """
    edges = F.array(F.struct(F.col("from_us").alias(at), F.lit(1).alias(name)),
                    F.struct(F.col("until_us").alias(at), F.lit(-1).alias(name)))
    steps = intervals.select(*keys, F.inline(edges)).where(F.col(at).isNotNull())
    return (nearest(probes, steps, keys, at, [name], inclusive=True, pick="sum")
            .withColumn(name, F.coalesce(name, F.lit(0))))
