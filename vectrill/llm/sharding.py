"""Sharding by histogram sort.

Rows are ordered by a key; the splitters between shards are keys. They are found by iteration: candidate boundaries
(probes) are sent to all partitions, every partition counts exactly the bytes and rows below each, and the probes are
refined inside the interval that holds each splitter, until the bytes are within the tolerance or the interval can't
be split further. Only then are rows exchanged, once.

The key is (crc32 of the text, 31 bits of a hash of the id), so that equal texts stand together and a large group of
them can still be divided; among rows that are equal in both, the position in the written table decides.

Python counts keys, positions and sizes only. Rows are placed by an expression, a binary search among the splitters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrill.llm.batches import bounded
from vectrill.llm.names import fresh, quoted, without
from vectrill.runtime import materialize

_TOP = (1 << 63) - 1
_COUNTED = "bucket long, bytes long, n long"


def _buckets(probes: np.ndarray, ties: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many probes (key, position) are at or below each row; probes are in order."""
    low = np.searchsorted(probes, key, "left")
    high = np.searchsorted(probes, key, "right")
    for row in np.flatnonzero(high > low):
        low[row] += np.searchsorted(ties[low[row] : high[row]], at[row], "right")
    return low


def _count(keyed: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) below each probe. Every partition sends a row per bucket, at most one more than probes."""
    keys = np.array([p[0] for p in probes], np.int64)
    ties = np.array([p[1] for p in probes], np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(keys) + 1), np.int64)
        for batch in batches:
            found = _buckets(keys, ties, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            # bincount sums in doubles, which are exact below 2**53 bytes a batch
            total[0] += np.bincount(found, batch.column(2).to_numpy(), len(keys) + 1).astype(np.int64)
            total[1] += np.bincount(found, minlength=len(keys) + 1)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "bytes", "n"])

    found = keyed.mapInArrow(partial, _COUNTED).groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    size, rows = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for r in found:
        size[r.bucket], rows[r.bucket] = r.bytes, r.n
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def find_splitters(keyed: DataFrame, parts: int, shards: int, tolerance: float = 0.001, fan: int = 16) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Splitters (key, position) at equal shares of the bytes, and the exact (bytes, rows) below each.

    ``keyed`` has three columns: key, position, size. Every round divides each interval that is still open by ``fan``,
    so that the rounds end by themselves.
    ``parts`` is a multiple of ``shards``; every splitter that is a shard's boundary meets ``tolerance`` (of a
    shard's bytes) or lies between two adjacent rows; the finer ones between are refined only as far as the first.
    """
    _, at, size = map(quoted, keyed.columns)
    total = keyed.agg(F.sum(size), F.count("*"), F.max(at)).first()
    everything, last = int(total[0] or 0), int(total[2] or 0)
    goals = [everything * i // parts for i in range(1, parts)]
    allowed = [max(1, int(everything / shards * tolerance)) if (i % (parts // shards)) == 0 else everything // parts // 2 for i in range(1, parts)]
    span = last + 1
    # a position in the order as one integer: key * span + row
    low, high = [0] * len(goals), [(_TOP + 1) * span] * len(goals)
    rows_low, rows_high = [0] * len(goals), [int(total[1])] * len(goals)
    best: list[tuple[int, int, int] | None] = [None] * len(goals)
    while True:
        todo = [i for i, b in enumerate(best) if (b is None or abs(b[1] - goals[i]) > allowed[i]) and high[i] - low[i] > 1 and (b is None or rows_high[i] - rows_low[i] > 1)]
        if not todo:
            break
        probes = sorted({low[i] + (high[i] - low[i]) * j // fan for i in todo for j in range(1, fan)} - {0})
        below, rows = _count(keyed, [(p // span, p % span) for p in probes])
        for i in todo:
            # the interval keeps the goal: low has at most the goal's bytes below it, high more
            at = int(np.searchsorted(below, goals[i], "right"))
            for j in (at - 1, at):
                if 0 <= j < len(probes) and (best[i] is None or abs(int(below[j]) - goals[i]) < abs(best[i][1] - goals[i])):
                    best[i] = (probes[j], int(below[j]), int(rows[j]))
            if at > 0 and probes[at - 1] > low[i]:
                low[i], rows_low[i] = probes[at - 1], int(rows[at - 1])
            if at < len(probes) and probes[at] < high[i]:
                high[i], rows_high[i] = probes[at], int(rows[at])
    if not everything:
        return [], []
    chosen = [b if b is not None else (0, 0, 0) for b in best]
    for i in range(1, len(chosen)):  # splitters never cross
        chosen[i] = max(chosen[i], chosen[i - 1])
    return [(p // span, p % span) for p, _, _ in chosen], [(b, n) for _, b, n in chosen]


def _part(splitters: list[tuple[int, int]], key: Column, at: Column) -> Column:
    """How many splitters are at or below a row's (key, position), by bisection."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    keys, ties = (F.expr(f"array({','.join(f'{s[i]}L' for s in splitters)})") for i in (0, 1))
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])

    def step(found: Column, by: Column) -> Column:
        there = F.least(found + by, F.lit(n))
        k = F.element_at(keys, there)
        low = (k < key) | ((k == key) & (F.element_at(ties, there) <= at))
        return F.when((found + by <= n) & low, found + by).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def shard(df: DataFrame, key: str = "doc_id", size: str = "size", text_crc32: str = "text_crc32", shards: int = 16, tolerance: float = 0.001, finer: int | None = None) -> DataFrame:
    """``df`` with ``law`` ('bytes'), ``shard``, ``slot`` and ``grown_shard`` (NULL under this law).

    ``size`` and ``text_crc32`` are columns of ``df``, not NULL. Slots are gapless from 0 in the order of the key.
    Each shard is exchanged as ``finer`` sub-ranges, so that many tasks share its rows; NULL keys are a value like
    any other, repeated rows are rows of their own, and an empty table gives an empty result. Columns of ``df`` that
    are called like an added one are replaced.
    """
    spark = bounded(df.sparkSession)
    finer = finer or max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    parts = shards * finer
    names = without(df, ("law", "shard", "slot", "grown_shard"))
    by, at, bytes_, part = fresh(df.columns, "_key", "_at", "_size", "_part")
    spread = F.xxhash64(F.coalesce(quoted(key).cast("string"), F.lit("\x00"))).bitwiseAND(F.lit((1 << 31) - 1))
    keyed = df.select(
        *map(quoted, names), F.shiftleft(quoted(text_crc32).cast("long"), 31).bitwiseOR(spread).alias(by),
        F.monotonically_increasing_id().alias(at), quoted(size).cast("long").alias(bytes_))
    keyed = materialize(keyed, "shard")
    splitters, below = find_splitters(keyed.select(by, at, bytes_), parts, shards, tolerance)
    firsts = [0, *(n for _, n in below)]
    shard_first = [firsts[i - i % finer] if firsts[1:] else 0 for i in range(len(firsts))]
    placed = keyed.withColumn(part, _part(splitters, F.col(by), F.col(at)))
    within = Window.partitionBy(part).orderBy(by, at)
    starts = F.expr(f"array({','.join(f'{a - b}L' for a, b in zip(firsts, shard_first, strict=True))})")
    slot = F.row_number().over(within) - 1 + F.element_at(starts, F.col(part) + 1)
    return placed.select(
        *map(quoted, names), F.lit("bytes").alias("law"), (F.col(part) / finer).cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
