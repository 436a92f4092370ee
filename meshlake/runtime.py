"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# functions of this package travel with the job, so workers need not have it installed
cloudpickle.register_pickle_by_value(sys.modules["meshlake"])

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "meshlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; a master only where none is configured."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own setting.

    Only where it is unset, as in tests on a local master, is a temporary folder
    of this machine used; on a cluster without the setting this raises.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="meshlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write df once to the shared folder as Parquet and read it back.

    This cuts the lineage: what follows survives the loss of any executor without
    running the steps before it again. The folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshlake/{name}-{uuid.uuid4().hex}"
    writer = df.write
    for key, value in (options or {}).items():
        writer = writer.option(key, value)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # what was shuffled is not read again, so its files go at once, not when the driver collects its garbage
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before) if before is not None else spark.conf.unset(CLEANUP_CONF)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def counted(df: DataFrame, name: str, **options) -> tuple[DataFrame, int]:
    """materialize, and the number of rows as the writing tasks saw it: no job of its own."""
    out, seen = observed(df, name, {"n": F.count(F.lit(1))}, **options)
    return out, seen["n"] or 0


def observed(df: DataFrame, name: str, metrics: dict, **options) -> tuple[DataFrame, dict]:
    """materialize, and aggregates of the rows taken while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[value.alias(key) for key, value in metrics.items()]), name, **options)
    found = seen.get
    return out, {key: found.get(key) for key in metrics}


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that are never broadcast.

    Spark takes what explode makes to be about as large as what it reads, so an index of
    many keys a row would be gathered in the driver.
    """
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def worker_cache() -> dict:
    """What a Python worker keeps from one task to the next."""
    return sys.modules.setdefault("_meshlake_cache", types.ModuleType("_meshlake_cache")).__dict__
