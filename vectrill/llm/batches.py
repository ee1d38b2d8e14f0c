"""How much of a table goes to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Texts have from one to very many words: Spark's 10,000 rows are up to 64 MB, which several tasks of an executor hold
#: several times over. Setting, Spark's default, and what is used instead.
BOUNDS = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
)


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with smaller bounds on Arrow batches unless it has set its own."""
    for name, default, value in BOUNDS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)
    return spark
