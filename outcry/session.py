"""Session helpers.

The engine is UTC-only (hour buckets, weekday and hour-of-day are UTC parts),
so every entry point pins ``spark.sql.session.timeZone`` to UTC.

Lineage cuts go to the shared folder named by ``spark.checkpoint.dir``.  On a
cluster that setting must come from the cluster; only a local session without
it gets a fresh scratch folder, which is removed when the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "outcry") -> SparkSession:
    """Local session with the settings the engine expects (used by tests/bench)."""
    master = master or os.environ.get("OUTCRY_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("OUTCRY_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", os.environ.get("OUTCRY_PARALLELISM_FIRST", "false"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("OUTCRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's setting; for a local master
    without one a scratch folder.  A folder of one machine would lose what the
    others write, so a cluster session without the setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get(_CKPT_KEY, None) or sc.getConf().get(_CKPT_KEY, None)
        if not current:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError(f"{_CKPT_KEY} must name a folder that the driver and all executors of {sc.master} share")
            current = tempfile.mkdtemp(prefix="outcry-ckpt-")
            atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


_AT_RELEASE: list[Callable[[], None]] = []


def at_release(action: Callable[[], None]) -> None:
    """Have ``release_scratch`` also do this (drop a table over scratch files, say)."""
    _AT_RELEASE.append(action)


def release_scratch(spark: SparkSession) -> None:
    """Delete what ``scratch_path`` has handed out to this application.  Call it
    when the frames built on it are no longer needed; results already written
    elsewhere stay."""
    while _AT_RELEASE:
        _AT_RELEASE.pop()()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: one computation, lineage cut, and file statistics for the planner
    (so joins against it get size-checked broadcast decisions)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``outcry`` package importable on executors (Python workers run
    pandas UDFs that call into it): zip it once per application and register
    it with ``addPyFile``, which distributes it with the job."""
    import outcry
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(outcry.__file__))
    fd, zpath = tempfile.mkstemp(prefix="outcry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
