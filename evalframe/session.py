"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Several joins feed a grouping on the same key, where AQE would leave a hot key's
    # join partition whole rather than add a shuffle. Splitting it is worth that shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions of one key merge inside each map task before the shuffle, so a hot key
    # ships a few open sessions instead of all of its rows.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

_local_base: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder is ``spark.checkpoint.dir``, or the context's checkpoint folder. Only a
    local master may fall back to a temporary folder.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="evalframe-")
        base = _local_base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def files_exist(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
