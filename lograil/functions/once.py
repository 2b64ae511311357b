"""Keep an expensive expression from being copied into every place that uses it."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like withColumns, but each value is computed once per row.

    Projections are merged and filters pushed through them by substitution, which
    would repeat a parse for every later use. A one-element generator is no such
    projection: later filters and columns read its output.
    """
    kept = [name for name in rows.columns if name not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value inside one expression."""
    return F.transform(F.array(value), body)[0]
