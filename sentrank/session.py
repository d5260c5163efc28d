"""Session settings and the shared folder for reliable intermediates."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sentrank", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone and make sure checkpoints have a home."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; a cluster
    without it is an error, because a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="sentrank-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder (streams, tables between two jobs)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several jobs must see the very same rows (assigned numbers, a
    neighbour index), or where recomputing an expensive branch would repeat it.
    The lineage ends there, the loss of an executor costs nothing, later jobs read
    only the columns they need, and the planner knows the size.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, otherwise unchanged.

    Meant for narrow settled tables, where the count is cheap. Unmarked, the join
    is a shuffled one with runtime skew handling.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder in any file system Spark can reach."""
    files, target = _hadoop(spark, path)
    return files.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop(spark, path)
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that an operator wrote for itself and that nothing reads any more."""
    files, target = _hadoop(spark, path)
    files.delete(target, True)
