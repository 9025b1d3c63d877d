"""Session helpers.

The library never creates a session behind the caller's back: operators take
DataFrames. These helpers exist for tests, the bench and the driver entry.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC session time (the fixtures are
# timestamp_ntz and the oracle is UTC-naive), AQE for runtime re-planning and
# skew splitting, and no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "candela") -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is only read here.
    Only on a local master (tests, bench) an unset folder is created and set.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="candela-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    try:
        spark.sparkContext.setCheckpointDir(cur)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        pass
    return cur


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for written tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``candela`` importable in the Python workers (pandas UDF folds,
    roll-forward, model solves): zip the package into a temporary file of the
    driver once per session; ``addPyFile`` serves it to the executors."""
    import zipfile
    if _SHIPPED.get(id(spark)) is spark:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="candela_", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    try:
        spark.sparkContext.addPyFile(zpath)
    except Exception:  # noqa: BLE001 - e.g. a session without a SparkContext handle
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED[id(spark)] = spark
