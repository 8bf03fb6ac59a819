"""Session helpers: one place for the settings every job relies on.

Jobs never hard-code a scratch folder. Lineage is cut with a reliable
``checkpoint()`` into the folder named by ``spark.checkpoint.dir``; a
folder is only invented when the setting is absent *and* Spark runs in
local mode (tests, the driver's smoke checks).
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set = set()

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "sqlfold") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SQLFOLD_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready for sqlfold jobs: checkpoint folder and the package on every executor."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (``addPyFile``) once per SparkContext.

    Python workers unpickle the per-partition functions by module path, so they
    need ``sqlfold`` importable wherever they run, not just on the driver.
    """
    sc = spark.sparkContext
    key = (id(sc), sc.applicationId)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    fd, path = tempfile.mkstemp(prefix="sqlfold-", suffix=".zip")
    with os.fdopen(fd, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(path)
    atexit.register(os.unlink, path)  # executors that start late still fetch it
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sqlfold-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Pin a DataFrame (e.g. a sampled range partitioning) so two passes see the same rows.

    A reliable checkpoint survives executor loss; ``localCheckpoint`` would not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    staged = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # the checkpoint write reads the persisted blocks instead of recomputing the input
        return staged.checkpoint(eager=True)
    finally:
        staged.unpersist()
