"""Session helpers: building a local session for tests/bench and resolving the
shared checkpoint folder a cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "prefspark") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC, Arrow on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PREFSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster configured; only when none is set
    (local tests) create a scratch one. On a cluster the setting must point at
    shared storage, so we never override it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        # A machine-local folder is invisible to other executors.
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage (HDFS/S3/...)")
    path = tempfile.mkdtemp(prefix="prefspark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make ``prefspark`` importable in Python workers (pandas UDFs, mapInPandas
    and foreachBatch callbacks unpickle references to it): zip the package once
    per SparkContext and register it with ``addPyFile``, which distributes it
    to every executor."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_prefspark_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="prefspark-pyfiles-"), "prefspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("prefspark", os.path.relpath(full, pkg)))
    sc.addPyFile(out)
    sc._prefspark_shipped = True


def materialize(df):
    """Cut lineage once for a DataFrame that is read several times (a count,
    range-bound sampling, the main pass): a reliable, eager ``checkpoint()`` into
    the shared checkpoint folder, so a lost executor does not recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
