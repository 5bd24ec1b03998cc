"""Tables that cut lineage (written once to the shared folder, then reread), and the package for the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the reliable checkpoint folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def settle(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and return the table read back.

    The files survive the loss of any executor, so nothing before this point is computed again. They stay until the
    checkpoint folder of the application is removed, because the caller's result may still read them.
    """
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that tasks can import it there.

    Batches of long texts are also kept small on their way to Python, which bounds what a worker holds.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix=f"{package.name}-package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
