"""Session settings and the shared scratch folder used for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows of repeated text are some ten times larger in memory than in a file or a
    # shuffle: tasks of this size sort without spilling, also as tables grow
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on (UTC clock, adaptive plans)."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def configure_streaming(spark: SparkSession) -> SparkSession:
    """`configure` plus a state store that keeps large state off the heap."""
    configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset folder is an error, because a machine-local path would lose data
    together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="dispatchlake-")
    return _local_folders[app]


_scope: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; write what is to last before that."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused between runs."""
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage at a durable table: later readers prune columns, see real
    sizes for join planning, and never recompute the producer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
