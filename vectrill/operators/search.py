"""Exact search: k-NN joins, range joins and distances to given candidates.

Tables are ``(id, vec, ...)``, queries ``(qid, qvec, ...)``. Results are in long form: ``(qid, rank, id, dis)`` for the k
nearest, ``(qid, id, dis)`` for ranges; missing ranks are missing rows. Equal distances go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions.distances import METRICS, Metric, metric
from vectrill.operators import blocks as K
from vectrill.operators.selectors import Selector
from vectrill.operators.topk import top_k

#: Queries are broadcast up to so many rows; more of them are handled in blocks of that size.
QUERY_BLOCK = K.QUERY_BLOCK
#: Rows of one group in a search list by list.
ROW_BLOCK = 50_000


def _selected(base: DataFrame, selector: Selector | None) -> DataFrame:
    return base if selector is None else selector.apply(base)


def all_pairs(queries: DataFrame, base: DataFrame, which: str | Metric = "l2", arg: float | None = None, selector: Selector | None = None) -> DataFrame:
    """``(qid, id, dis)`` for every query and row. The smaller side by the optimizer's estimate is broadcast.

    A selector filters the base table ahead of the join.
    """
    m = metric(which)
    return _selected(base, selector).crossJoin(queries).select("qid", "id", m(F.col("qvec"), F.col("vec"), arg).alias("dis"))


def kernel_of(m: Metric) -> K.Kernel | None:
    """The blocks' kernel of a metric, unless another expression has been put under its name."""
    return K.KERNELS.get(m.name) if METRICS.get(m.name) is m and m.expression.__module__ == Metric.__module__ else None


def knn(queries: DataFrame, base: DataFrame, k: int, which: str | Metric = "l2", arg: float | None = None, selector: Selector | None = None, digits: int | None = None) -> DataFrame:
    """The k nearest rows of each query. NaN distances rank last. With ``digits``, rounded distances are compared.

    Metrics with a kernel are measured in blocks (``operators/blocks.py``): a task keeps k rows of each query.
    """
    m = metric(which)
    rounded = lambda df: df if digits is None else df.withColumn("dis", F.round("dis", digits))
    if kernel_of(m) is None:
        pairs = all_pairs(queries, base, m, arg, selector)
    else:
        slack = 0.0 if digits is None else 1.01 * 10.0**-digits
        pairs = K.pairs(queries, _selected(base, selector), kernel_of(m), lambda q, b: all_pairs(q, b, m, arg), arg, k=k, slack=slack)
    return top_k(rounded(pairs), k, descending=m.similarity).select("qid", "rank", "id", "dis")


def pairs_from_product(queries: DataFrame, base: DataFrame) -> DataFrame:
    """``(qid, id, dis)`` of every query and row: the squared distance from squared norms and the inner product."""

    def plain(q: DataFrame, b: DataFrame) -> DataFrame:
        x, y = F.col("qvec"), F.col("vec")
        return b.crossJoin(q).select("qid", "id", D.l2_from_product(D.norm_squared(x), D.norm_squared(y), D.inner_product(x, y)).alias("dis"))

    return K.pairs(queries, base, K.FROM_PRODUCT, plain)


def range_join(queries: DataFrame, base: DataFrame, radius: float, which: str | Metric = "l2", arg: float | None = None, selector: Selector | None = None) -> DataFrame:
    """Rows strictly nearer than ``radius``: ``dis < radius``, and ``dis > radius`` for similarities."""
    m = metric(which)
    if kernel_of(m) is None:
        pairs = all_pairs(queries, base, m, arg, selector)
    else:
        pairs = K.pairs(queries, _selected(base, selector), kernel_of(m), lambda q, b: all_pairs(q, b, m, arg), arg, radius=float(radius))
    return pairs.where((F.col("dis") > radius if m.similarity else F.col("dis") < radius) & ~F.isnan("dis"))


def range_counts(queries: DataFrame, base: DataFrame, radii: list[float], which: str | Metric = "l2", arg: float | None = None) -> DataFrame:
    """``(qid, n0, n1, ...)``: how many rows :func:`range_join` finds for each radius, without making them.

    Queries without a row within any radius may be missing.
    """
    m = metric(which)
    if kernel_of(m) is not None:
        return K.counts(queries, base, kernel_of(m), lambda q, b: all_pairs(q, b, m, arg), radii, arg)
    dis = F.col("dis")
    inside = [((dis > r) if m.similarity else (dis < r)) & ~F.isnan(dis) for r in radii]
    return all_pairs(queries, base, m, arg).groupBy("qid").agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(inside)))


def assign(queries: DataFrame, base: DataFrame, which: str | Metric = "l2", arg: float | None = None) -> DataFrame:
    """The nearest row's id of each query."""
    m = metric(which)
    pairs = all_pairs(queries, base, m, arg)
    best = F.struct((-F.col("dis") if m.similarity else F.col("dis")).alias("d"), F.col("id").alias("id"))
    return pairs.groupBy("qid").agg(F.min(best)["id"].alias("id"))


def distances_to(candidates: DataFrame, queries: DataFrame, base: DataFrame, which: str | Metric = "l2", arg: float | None = None) -> DataFrame:
    """Distances of given pairs ``(qid, id)``: two equi-joins, no ranking."""
    m = metric(which)
    return candidates.join(queries, "qid").join(base, "id").select("qid", "id", m(F.col("qvec"), F.col("vec"), arg).alias("dis"))


def knn_among(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, which: str | Metric = "l2", arg: float | None = None) -> DataFrame:
    """The k nearest among each query's own candidates ``(qid, id)``."""
    m = metric(which)
    return top_k(distances_to(candidates, queries, base, m, arg), k, descending=m.similarity).select("qid", "rank", "id", "dis")


def with_vectors(result: DataFrame, base: DataFrame, columns: tuple[str, ...] = ("vec",)) -> DataFrame:
    """Search results joined with columns of the rows found."""
    return result.join(base.select("id", *columns), "id")


def merge_results(results: list[DataFrame], k: int, similarity: bool = False) -> DataFrame:
    """Top-k of several result tables, as of shards or of database blocks."""
    joined = results[0].select("qid", "id", "dis")
    for r in results[1:]:
        joined = joined.unionByName(r.select("qid", "id", "dis"))
    return top_k(joined, k, descending=similarity).select("qid", "rank", "id", "dis")


def limit_results(result: DataFrame, most: int, similarity: bool = False) -> DataFrame:
    """Shrink the radius of a range result until at most ``most`` rows are left in all.

    The new radius is the distance at position ``most`` of all rows in order, applied strictly; fewer rows stay.
    The position is found by an ordered limit, which keeps no more than ``most + 1`` rows.
    """
    order = F.col("dis").desc() if similarity else F.col("dis").asc()
    edge = result.select("dis").orderBy(order).limit(most + 1)
    cut = edge.agg(F.count("*").alias("_n"), (F.min("dis") if similarity else F.max("dis")).alias("_r"))
    inside = F.col("dis") > F.col("_r") if similarity else F.col("dis") < F.col("_r")
    return result.crossJoin(F.broadcast(cut)).where((F.col("_n") <= most) | inside).select(*result.columns)


def range_limited(queries: DataFrame, base: DataFrame, radius: float, most: int, which: str | Metric = "l2") -> DataFrame:
    """:func:`limit_results` of :func:`range_join`, without making the rows that are cut off again.

    At most ``most`` rows stay in all, so that they, and the next one, are among each query's ``most + 1`` nearest.
    """
    m = metric(which)
    near = knn(queries, base, most + 1, m).select("qid", "id", "dis")
    near = near.where((F.col("dis") > radius if m.similarity else F.col("dis") < radius) & ~F.isnan("dis"))
    return limit_results(near, most, m.similarity)


def _block_top(queries: np.ndarray, ids: np.ndarray, norms: np.ndarray, k: int, similarity: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best_d = np.full((len(ids), 0), np.inf)
    best_i = np.zeros((len(ids), 0), np.int64)
    for batch in batches:
        base_ids = batch.column(0).to_numpy()
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if not len(base_ids):
            continue
        x = flat.reshape(len(base_ids), -1)
        for at in range(0, len(x), 4096):
            part, part_ids = x[at : at + 4096], base_ids[at : at + 4096]
            d = queries @ part.T
            d = -d if similarity else norms[:, None] + (part * part).sum(axis=1)[None, :] - 2 * d
            d = np.concatenate([best_d, d], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(part_ids, (len(ids), len(part_ids)))], axis=1)
            if d.shape[1] > k:
                keep = np.argpartition(d, k - 1, axis=1)[:, :k]
                d, i = np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)
            best_d, best_i = d, i
    n = best_d.shape[1]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array((-best_d if similarity else best_d).ravel())], names=["qid", "id", "dis"])


def knn_blocks(queries: DataFrame, base: DataFrame, k: int, which: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """k-NN by matrix products: each task keeps k candidates per query of a block, and a shuffle merges them.

    For "l2" and "ip". Memory of a task is one block of queries and its candidates. More queries than a block are
    handled in several passes over the base table. Distances are rounded differently from :func:`knn`, by
    about 1e-15 relative to the norms.
    """
    if which not in ("l2", "ip"):
        raise ValueError("matrix products give l2 and ip only")
    n = queries.count()
    blocks = max(1, -(-n // block))
    numbered = queries if blocks == 1 else queries.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    results = []
    context = base.sparkSession.sparkContext
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.col("_b") == b)
        found = part.select("qid", "qvec").toArrow()
        ids = found.column(0).to_numpy()
        q = np.array(found.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
        sent = context.broadcast((ids, q, (q * q).sum(axis=1)))

        def local(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, norms = sent.value
            return _block_top(q, ids, norms, k, which == "ip", batches)

        results.append(base.select("id", "vec").mapInArrow(local, "qid long, id long, dis double"))
    return merge_results(results, k, which == "ip")
