"""Session defaults and staged tables.

Iterative operators cut their lineage by writing a table to the folder that all executors share
(``spark.checkpoint.dir``).  The files survive the loss of any executor, they are columnar and
compressed, and a round can drop the table of the round before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: dict[int, str] = {}
_staged: set[tuple[str, str]] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session with UTC, adaptive execution and Arrow, as all operators here expect."""
    builder = (
        SparkSession.builder.master(master)
        .appName("mediaframe")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else (local masters only) an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _own_root:
        _own_root[key] = "file://" + tempfile.mkdtemp(prefix="mediaframe-")
        spark.sparkContext.setCheckpointDir(_own_root[key])
    return _own_root[key]


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/mediaframe/{name}-{uuid.uuid4().hex}"
    _staged.add((spark.sparkContext.applicationId, path))
    return path


def stage(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a checkpoint in columnar form.

    ``by`` names a column to partition the files by."""
    path = staged_path(df.sparkSession, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def stage_counted(df: DataFrame, condition: Column, name: str = "t") -> tuple[DataFrame, int]:
    """``stage`` and the number of rows with a condition, counted while they are written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count_if(condition).alias("n")), name)
    return out, seen.get["n"]


def unstage(df: DataFrame | None) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        delete_path(df.sparkSession, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _staged.discard((spark.sparkContext.applicationId, path))


@atexit.register
def _cleanup() -> None:
    spark = SparkSession.getActiveSession()
    for app, path in list(_staged):
        try:
            if spark is not None and spark.sparkContext.applicationId == app:
                delete_path(spark, path)
        except Exception:  # the JVM may be gone already
            return
