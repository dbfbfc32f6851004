"""Session factory and shared-folder helpers.

Settings that every job relies on are applied here once:

* UTC session time zone, ANSI mode on (string-to-number casts raise, so the
  library uses ``try_cast`` where the reference relied on SQLite affinity).
* Partition-column type inference off: ``municipio_id=0162`` must stay the
  string ``"0162"``.
* Dynamic partition overwrite: a write replaces only the partitions present in
  the written DataFrame (the commit unit of the reference is one month).
* AQE with partition coalescing and skew-join splitting.

On a cluster the session already exists; ``get_spark`` only fills in settings
that are unset, it never overrides what the cluster configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows hold whole texts: a batch of 10,000 would not fit beside a small heap
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def get_spark(app: str = "erario", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("ERARIO_MASTER", "local[*]"))
    builder = builder.config("spark.ui.enabled", "false")
    # checkpointed scans go when the DataFrames that use them go
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    builder = builder.config("spark.driver.memory", os.environ.get("ERARIO_DRIVER_MEMORY", "8g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set library defaults only where the session leaves them unset, and make
    the package importable by the Python workers."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (``addPyFile``), once
    per SparkContext. Python tasks import
    it there; the driver's own ``sys.path`` is not seen by the workers."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="erario-pyfiles-"), "erario.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset in local mode (tests) a private
    temporary folder is created and recorded in the session so later calls
    agree. On a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (a machine-local "
                               "temporary folder does not survive a lost executor)")
        path = tempfile.mkdtemp(prefix="erario-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for staging tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/erario/{name}-{uuid.uuid4().hex[:12]}"
