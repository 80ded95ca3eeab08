"""Session helpers: a local session for tests, the shared scratch folder, kept tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Temporary folders of local sessions that name no shared one, by application.
_temporary: dict[str, str] = {}


def local_session(app_name: str = "armspan", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session for tests and local benchmarks; on a cluster use spark-submit's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder, which goes when the process
    ends: on a cluster that would scatter the files over the machines' own disks.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _temporary:
        folder = _temporary[application] = tempfile.mkdtemp(prefix="armspan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _temporary[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has written yet."""
    return os.path.join(shared_folder(spark), "armspan", f"{label}-{uuid.uuid4().hex}")


def require_new(spark: SparkSession, path: str) -> None:
    """Fails if ``path`` exists, before hours of work end at it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(f"{path} already exists")


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """Keeps ``rows`` in memory and on disk while several jobs read them.

    Rows that the caller already keeps stay kept.
    """
    if rows.is_cached:
        yield rows
        return
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()
