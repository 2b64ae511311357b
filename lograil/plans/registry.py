"""Named queries and their SQL twins."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lograil.plans.obs import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, extra: str = "", recursive=False):
    """Register a function as a query; `sql` is the final SELECT after the shared prelude."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            more = f",{extra}" if extra else ""
            ORACLES[function.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{PRELUDE.strip()}{more}\n{sql.strip()}"
        return function
    return register
