"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are designed for. A cluster submits its own master, memory and parallelism.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "echolens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_fallback_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a local folder stands in for a missing setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "local") or "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback_root:
            _fallback_root[app] = tempfile.mkdtemp(prefix="echolens-")
        root = _fallback_root[app]
    return root.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Give iterative algorithms a checkpoint folder unless the cluster has named one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_root(spark)}/checkpoints")


#: Spark's switch that removes a query's shuffle files when the query ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """For a write whose shuffles nothing reads again: their files go with it and not when the driver happens to collect garbage."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later steps read and return it read back, with its lineage cut. Nothing reads the shuffles behind it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with tidied(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these very frames; nothing may read them, or what is derived from them, any more."""
    for frame in frames:
        remove(frame.sparkSession, frame.stored_path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that this call has written and nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
