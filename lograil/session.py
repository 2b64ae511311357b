"""Session settings and durable intermediate results."""
import gc
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: UTC days and hours, runtime re-planning."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Sessions of a busy actor are merged before the shuffle, not after it.
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lograil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write a reused intermediate as a table on shared storage and read it back; `options` are the writer's.

    Lineage ends at the files, so a lost executor recomputes nothing before them,
    and the known file sizes let later joins be planned on facts. All tables of an
    application lie in one folder, which may be removed when its results are stored.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lograil-{spark.sparkContext.applicationId}/{uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Shuffles that nothing refers to any more leave the executors' disks when the driver collects garbage: now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again; each is one that `durable` returned."""
    for stored in tables:
        spark = stored.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in stored.inputFiles() if f"/lograil-{spark.sparkContext.applicationId}/" in name}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
