"""Session helpers shared by operators: table access, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where the session names none (tests, laptops)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vectrill-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vectrill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    written = spark.read.schema(df.schema).parquet(path)
    written._written_path = path
    return written


def written_bytes(df: DataFrame) -> int:
    """The size of the files of a table that :func:`materialize` wrote. No job is run for it."""
    target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_path)
    return target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def mark() -> int:
    """Where the list of written tables ends now, for :func:`discard`."""
    return len(_WRITTEN)


def discard(since: int, *keep: DataFrame) -> None:
    """Delete the tables written since a mark, but for those in ``keep``. Nothing that is still to run may read them."""
    kept = {df._written_path for df in keep}
    tail = _WRITTEN[since:]
    del _WRITTEN[since:]
    for spark, path in tail:
        if path in kept:
            _WRITTEN.append((spark, path))
        else:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete every table that :func:`materialize` wrote."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # the session may be gone at exit
            if os.environ.get("VECTRILL_DEBUG"):
                raise


atexit.register(release)
