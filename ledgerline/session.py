"""Session helpers: settings the operators rely on and reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

UTC_ZONE = "UTC"


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times are instants; pin the session zone so casts and formats agree everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != UTC_ZONE:
        spark.conf.set("spark.sql.session.timeZone", UTC_ZONE)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a private folder; on a cluster a machine-local
    folder would be lost with its machine, so that is refused.
    """
    context = spark.sparkContext
    # Spark deletes the files of a checkpoint once nothing refers to it any more.
    context._conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the reliable checkpoint folder and continue from there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
