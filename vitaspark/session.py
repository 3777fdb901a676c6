"""Session defaults used by the jobs, tests and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "vitaspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the plans rely on.

    Nothing here fixes a partition count for a cluster: AQE coalesces from
    ``spark.sql.shuffle.partitions``, which the caller sizes for its data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only when ``spark.checkpoint.dir`` is unset and no folder was set on the
    context (tests, a laptop) is a local one made. On a cluster master without
    a shared folder this raises, as a machine-local folder would be lost with
    its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix=f"run-checkpoint-{os.getpid()}-")
    context.setCheckpointDir(configured)
    return configured
