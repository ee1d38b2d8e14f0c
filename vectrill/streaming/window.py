"""Sliding windows of vectors: slices come in, the oldest go, and the window can be searched at any time.

Rows are appended with their slice; a slice leaves by the predicate on its number, and ``compact`` rewrites the table
without those that left. Structured Streaming drives it by ``foreachBatch``; event-time windows use a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrill.operators.clustering import assign_to


def live_slices(rows: DataFrame, newest: int, n: int, slice_id: str = "slice_id") -> DataFrame:
    """Rows of the last ``n`` slices up to ``newest``."""
    return rows.where((F.col(slice_id) > newest - n) & (F.col(slice_id) <= newest))


def replay_count_window(rows: DataFrame, window: int, batch: int) -> DataFrame:
    """(step, low, high, n): ids alive after each batch of ``batch`` rows, if the oldest over ``window`` go. Ids are dense."""
    steps = rows.select(F.floor(F.col("id") / batch).alias("step"), "id").groupBy("step").agg(F.max("id").alias("high"))
    low = F.greatest(F.lit(0), F.col("high") + 1 - window)
    return steps.select("step", low.cast("long").alias("low"), F.col("high").cast("long"), (F.col("high") + 1 - low).cast("long").alias("n"))


class SlidingIndex:
    """A FIFO of slices over a Parquet folder partitioned by slice. The numbers of the live slices are kept beside them in
    ``_live``, so that a window goes on after a restart."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray | None = None):
        self.spark, self.path, self.centroids = spark, path, centroids
        self.slices: list[int] = []
        self.next = 0
        jvm = spark.sparkContext._jvm
        self._live = jvm.org.apache.hadoop.fs.Path(f"{path}/_live")
        self._fs = self._live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(self._live):
            stream = self._fs.open(self._live)
            numbers = [int(x) for x in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()]
            stream.close()
            self.next, self.slices = numbers[0], numbers[1:]

    def _keep(self) -> None:
        stream = self._fs.create(self._live, True)
        stream.write(" ".join(map(str, [self.next, *self.slices])).encode())
        stream.close()

    def step(self, rows: DataFrame | None = None, remove_oldest: bool = False, number: int | None = None) -> None:
        """Add a slice, remove the oldest, or both. A slice of a ``number`` that is there already is replaced."""
        if rows is None and not remove_oldest:
            raise ValueError("a step adds a slice, removes one, or both")
        if remove_oldest and not self.slices:
            raise ValueError("there is no slice to remove")
        if rows is not None:
            if self.centroids is not None:
                rows = assign_to(rows, self.centroids).drop("dis")
            number = self.next if number is None else number
            rows.write.mode("overwrite").parquet(f"{self.path}/slice_id={number}")
            if number not in self.slices:
                self.slices.append(number)
            self.next = max(self.next, number + 1)
        if remove_oldest:
            self.slices.pop(0)
        self._keep()

    def rows(self) -> DataFrame | None:
        if not self.slices:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/slice_id={s}" for s in self.slices])

    def compact(self) -> None:
        """Delete the folders of slices that left."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for s in range(self.next):
            if s not in self.slices:
                target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/slice_id={s}")
                target.getFileSystem(conf).delete(target, True)

    def consume(self, stream: DataFrame, window: int, checkpoint: str, **options):
        """Every micro-batch of a stream becomes the slice of its number; the oldest goes beyond ``window`` slices.

        A window that a stream feeds takes no other steps. A batch that is run again after a restart replaces its slice, or is passed over if that has left the window.
        """

        def each(batch: DataFrame, number: int) -> None:
            again = number in self.slices
            if not batch.isEmpty() and (again or number >= self.next):
                self.step(batch, not again and len(self.slices) >= window, number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).options(**options).start()


def assign_stream(stream: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assignment by a trained model is stateless: the same expressions on a stream as on a table."""
    return assign_to(stream, centroids)


def windowed_assignments(events: DataFrame, centroids: np.ndarray, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(begin, list_no, n, mean_dis) of event-time windows, over a stream or a table with ``ts`` and ``vec``."""
    if events.isStreaming:  # watermarks need a timestamp with a time zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    assigned = assign_to(events, centroids)
    grouped = assigned.groupBy(F.window("ts", length, slide or length).alias("w"), "list_no")
    return grouped.agg(F.count("*").alias("n"), F.avg("dis").alias("mean_dis")).select(F.col("w.start").alias("begin"), "list_no", "n", "mean_dis")


def run_to_end(query, timeout: float | None = None) -> None:
    """Work off what there is and stop; with a timeout, stop then in any case."""
    try:
        if timeout is None:
            query.processAllAvailable()
        else:
            query.awaitTermination(timeout)
    finally:
        query.stop()


def into_table(stream: DataFrame, name: str, mode: str = "append", before: Callable[[DataFrame], DataFrame] | None = None):
    out = before(stream) if before else stream
    return out.writeStream.outputMode(mode).format("memory").queryName(name).start()


def latest(rows: DataFrame, key: str = "id", order: str = "ts") -> DataFrame:
    """The last version of each key, for upserts from a stream."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
