"""Connected components of a table of links, by alternating large and small stars.

Every step is a group-by with partial aggregation and a join, written to the shared folder. Nothing is gathered on the
driver but two numbers that tell whether the links still change. Few links are joined up by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.runtime import materialize, written_bytes

#: A side of at most this many rows of two longs is broadcast, a larger one is joined by a shuffle; so many links are
#: joined up by one task.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its files hold no more than ``limit`` rows of two longs."""
    return F.broadcast(df) if written_bytes(df) <= 16 * limit else df


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) from (a, b), by union-find."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a), above.setdefault(b, b)
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "label"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``links(a, b)`` to ``(node, label)``: for every node with a link to another, the smallest node it reaches.

    NULL ends and links of a node to itself are dropped, direction and repetition don't matter; no links, no rows.
    """
    edges = links.select("a", "b").where("a <> b")
    if edges.count() <= limit:
        return edges.coalesce(1).mapInArrow(_joined_up, "node long, label long")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        # large star: what is larger than u among its neighbours hangs below the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(sized(least, limit), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        # small star: u and its smaller neighbours hang below the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(sized(least, limit), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
