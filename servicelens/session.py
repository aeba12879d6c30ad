"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


# Settings the jobs profit from. The JVM does not compile methods over 8000 bytes; the wide
# projections of record cleaning generate larger ones, which then run interpreted. With the limit
# Spark falls back to smaller generated methods instead.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints: the one the cluster names, if it names one.

    Only a local session without the setting gets a folder of its own; on a cluster a folder of one
    machine would be lost with it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()
