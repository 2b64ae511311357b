"""Settings, table access and joins that the operators of this folder share."""
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.session import configure

# A table is sent to every task only if it has been counted and has no more rows than this; a row
# here is a key and a few numbers, so that is at most some ten megabytes. Larger ones are shuffled.
BROADCAST_ROWS = 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings; batches sent to Python stay small whatever the length of texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text itself; a null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def sized(stored: DataFrame) -> DataFrame:
    """A stored table as the build side of a join: broadcast if its count is within the bound.

    Beyond the bound the join is an ordinary shuffled one; both give the same rows.
    """
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which null equals null."""
    condition = F.lit(True)
    for name in names:
        condition &= left[name].eqNullSafe(right[name])
    return condition


def fold(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


_REMEMBERED: dict = {}


def remembered(make, *given):
    """What `make` returns, kept over the tasks of a Python worker until the worker asks for something else.

    Workers go from one operator's tasks to the next one's; what the former has learned would else stay in memory.
    """
    key = (make, *given)
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        _REMEMBERED[key] = make(*given)
    return _REMEMBERED[key]
