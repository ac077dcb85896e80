"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only
fills in settings that are still unset, so cluster-wide choices win.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI on (0-division must be handled with
# nullif/try_divide), UTC, AQE with skew-join splitting and partition
# coalescing, Arrow for the few pandas UDFs.
_DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 128 MiB splits keep scan tasks bounded at any table size.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sway") -> SparkSession:
    """Local/test session. On a cluster use the provided session and call ``configure``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # remove checkpoint files of materialised intermediates once they are unreferenced
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", os.environ.get("SWAY_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply defaults that are still unset, make sure a checkpoint folder exists, ship the package."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can
    import it wherever they run."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    _shipped.add(app)
    target = os.path.join(tempfile.mkdtemp(prefix="sway-package-"), "sway_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(target)  # served by the driver, which copies it


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset on a local master (tests) a
    scratch folder is created and registered.  On a cluster it must be set: a folder of
    the driver's own disk would be invisible to the executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() or ""
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sway-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Shuffle files of a query go when it ends, instead of when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, tidy: bool = False):
    """Compute a small, bounded intermediate once and cut its lineage.

    Used for aggregates (bounded by the study's key domain) that feed several branches
    of one query, so the fact table behind them is scanned once instead of once per
    branch.  The data goes to the shared checkpoint folder (``spark.checkpoint.dir``),
    so a lost executor does not force recomputation from the fact table.  With ``tidy``
    the shuffle files it took are removed as soon as it is written."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not tidy:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query planned under the setting
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
