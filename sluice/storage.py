"""Storage that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the session's checkpoint folder names.

    A session that names none gets a temporary folder if driver and executors are one process; on a cluster it is refused."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        master = context.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="sluice-")
        _made.append(named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder under the shared one; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _remove() -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    for path in _made:
        try:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the gateway may be gone already
            return
