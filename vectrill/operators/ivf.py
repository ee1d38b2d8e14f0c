"""Inverted-file search: rows are assigned to lists by a coarse quantizer, and a query looks into some lists only.

An index is a table ``(list_no, id, vec or code, ...)``; written with ``partitionBy("list_no")``, probing prunes
partitions. Probes are a table ``(qid, qvec, list_no, probe)``, and the scan is an equi-join on ``list_no``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators.blocks import KERNELS, ahead, exact_matrix, pairs
from vectrill.operators.clustering import INLINE, assign_to
from vectrill.operators.search import QUERY_BLOCK, ROW_BLOCK, all_pairs, distances_to, kernel_of, knn
from vectrill.operators.selectors import Selector
from vectrill.operators.topk import top_k
from vectrill.runtime import materialize

#: Centroids of more bytes are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int, which: str = "l2") -> DataFrame:
    """(qid, qvec, list_no, probe, coarse): the ``nprobe`` best lists of each query. ``centroids`` are (list_no, centroid)."""
    m = D.metric(which)
    pairs = queries.crossJoin(F.broadcast(centroids)).withColumn("coarse", m(F.col("qvec"), F.col("centroid")))
    ranked = top_k(pairs, nprobe, by="coarse", query="qid", tie="list_no", descending=m.similarity)
    return ranked.withColumnRenamed("rank", "probe")


def limit_rows(probes: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """Stop probing once the lists before have ``most`` rows or more."""
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("qid").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)
    seen = probes.join(sizes, "list_no", "left").fillna(0, ["_n"]).withColumn("_seen", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return seen.where(F.col("_seen") < most).drop("_n", "_seen")


def _assigned(base: DataFrame, centroids: np.ndarray, similarity: bool) -> DataFrame:
    """``base`` with the ``list_no`` that :func:`assign_to` gives, by the same numbers, measured in blocks."""
    if centroids.size > INLINE or "list_no" in base.columns:
        return assign_to(base, centroids, "vec", similarity).drop("dis")
    kernel, names = KERNELS["ip" if similarity else "l2"], base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("list_no", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(names.index("vec"))
            near = np.zeros(len(batch), np.int32)  # also of vectors that have NULL or another length
            own = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vec), centroids.shape[1]), False).to_numpy(zero_copy_only=False))
            flat = pc.list_flatten(vec.take(pa.array(own)))
            if flat.null_count:
                there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(own), -1).all(axis=1)
                own, flat = own[there], flat.filter(pa.array(np.repeat(there, centroids.shape[1])))
            if len(own):
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                with np.errstate(all="ignore"):
                    d = exact_matrix(kernel, x, centroids, None)
                near[own] = np.lexsort((-d if similarity else d, np.isnan(d)), axis=1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*names, "list_no"])

    return base.mapInArrow(run, schema)


@dataclass
class Inverted:
    """Lists with the centroids that made them. ``residual`` rows hold vectors minus their list's centroid."""

    centroids: DataFrame
    lists: DataFrame
    which: str = "l2"
    residual: bool = False

    @classmethod
    def build(cls, base: DataFrame, centroids: np.ndarray, which: str = "l2", residual: bool = False) -> Inverted:
        similarity = D.metric(which).similarity
        spark = base.sparkSession
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(np.asarray(centroids, float))], "list_no int, centroid array<double>")
        lists = _assigned(base, np.asarray(centroids, float), similarity)
        if residual:
            few = F.broadcast(table) if np.asarray(centroids, float).nbytes <= BROADCAST_BYTES else table
            lists = lists.join(few, "list_no").withColumn("vec", V.subtract(F.col("vec"), F.col("centroid"))).drop("centroid")
        return cls(table, lists, which, residual)

    def add(self, rows: DataFrame) -> Inverted:
        """More rows under the same centroids."""
        centroids = np.array([r["centroid"] for r in self.centroids.orderBy("list_no").collect()])
        more = Inverted.build(rows, centroids, self.which, self.residual)
        return Inverted(self.centroids, self.lists.unionByName(more.lists), self.which, self.residual)

    def remove(self, ids: DataFrame) -> Inverted:
        return Inverted(self.centroids, self.lists.join(ids.select("id"), "id", "left_anti"), self.which, self.residual)

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        found = self.lists.join(ids.select("id"), "id", "left_semi")
        return found.join(F.broadcast(self.centroids), "list_no").withColumn("vec", V.add(F.col("vec"), F.col("centroid"))).drop("centroid") if self.residual else found

    def probe(self, queries: DataFrame, nprobe: int) -> DataFrame:
        return probe(queries, self.centroids, nprobe, self.which)

    def scan(self, probes: DataFrame, distance: Callable[[Column, Column], Column] | None = None, selector: Selector | None = None, most_rows: int | None = None) -> DataFrame:
        """(qid, id, list_no, dis) of all rows in the probed lists. The caller may give the probes."""
        lists = self.lists if selector is None else selector.apply(self.lists)
        if most_rows is not None:
            probes = limit_rows(probes, self.lists, most_rows)
        f = distance or D.metric(self.which)
        joined = probes.join(lists, "list_no")
        q = V.subtract(F.col("qvec"), F.col("centroid")) if self.residual and self.which == "l2" else F.col("qvec")
        dis = f(q, F.col("vec"))
        if self.residual and self.which == "ip":
            dis = dis + F.col("coarse")
        return joined.select("qid", "id", "list_no", dis.alias("dis"))

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, **how) -> DataFrame:
        """(qid, rank, id, dis, list_no)."""
        found = self._nearest(queries, k, nprobe, **how) if set(how) <= {"selector"} and (self.which == "l2" or not self.residual) else None
        if found is None:
            found = self.scan(self.probe(queries, nprobe), **how)
        return top_k(found, k, descending=D.metric(self.which).similarity).select("qid", "rank", "id", "dis", "list_no")

    def _nearest(self, queries: DataFrame, k: int, nprobe: int, selector: Selector | None = None) -> DataFrame | None:
        """The nearest of each task's rows, measured in blocks of a list's rows and its queries; None if the metric has no kernel."""
        kernel = kernel_of(D.metric(self.which))
        if kernel is None:
            return None

        def plain(q: DataFrame, rows: DataFrame) -> DataFrame:
            probes = q.select("qid", "qvec", F.explode("lists").alias("list_no")).join(F.broadcast(self.centroids), "list_no")
            return Inverted(self.centroids, rows, self.which, self.residual).scan(probes)

        numbers = [r["list_no"] for r in self.centroids.select("list_no").limit(nprobe + 1).collect()]
        if len(numbers) <= nprobe:  # all of them, in whatever order
            probing = queries.select("qid", "qvec", F.array(*map(F.lit, sorted(numbers))).alias("lists"))
        else:
            probing = materialize(self.probe(queries, nprobe).groupBy("qid").agg(F.first("qvec").alias("qvec"), F.collect_list("list_no").alias("lists")), "probes")
        centres = {r["list_no"]: np.array(r["centroid"], float) for r in self.centroids.collect()} if self.residual else None
        # written once, as the ways to lists and codes are long expressions
        rows = materialize((self.lists if selector is None else selector.apply(self.lists)).select("id", "vec", "list_no"), "lists")
        return pairs(probing, rows, kernel, plain, k=k, centroids=centres)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, **how) -> DataFrame:
        similarity = D.metric(self.which).similarity
        found = self.scan(self.probe(queries, nprobe), **how)
        return found.where(F.col("dis") > radius if similarity else F.col("dis") < radius)

    def search_big(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        """Many queries: probes and rows meet list by list, and distances come from matrix products.

        A group is at most about ``QUERY_BLOCK`` queries and ``ROW_BLOCK`` rows of a list: larger lists, and lists
        that many queries probe, are divided by hashes, and each part of the one side meets each of the other.
        """
        similarity = D.metric(self.which).similarity
        probes = self.probe(queries, nprobe).select("list_no", "qid", "qvec")
        rows = self.lists.select("list_no", "id", "vec")
        count = lambda df, block, name: df.groupBy("list_no").agg(F.ceil(F.count("*") / block).alias(name))
        parts = count(rows, ROW_BLOCK, "_rows").join(count(probes, QUERY_BLOCK, "_queries"), "list_no")  # a row per list
        probes = probes.join(parts, "list_no").withColumn("_q", F.pmod(F.xxhash64("qid"), F.col("_queries"))).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1))).drop("_rows", "_queries")
        rows = rows.join(parts, "list_no").withColumn("_r", F.pmod(F.xxhash64("id"), F.col("_rows"))).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_queries") - 1))).drop("_rows", "_queries")
        schema = "qid long, id long, dis double"

        def match(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(rows):
                return pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "dis": pd.Series(dtype="float64")})
            b = np.stack(rows["vec"].to_numpy()).astype(float)
            ids, out = rows["id"].to_numpy(), []
            for start in range(0, len(q), 1024):
                part = q.iloc[start : start + 1024]
                a = np.stack(part["qvec"].to_numpy()).astype(float)
                d = a @ b.T
                d = -d if similarity else (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * d
                keep = np.argsort(d, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), keep.shape[1]), "id": ids[keep].ravel(), "dis": np.take_along_axis(d, keep, 1).ravel() * (-1 if similarity else 1)}))
            return pd.concat(out)

        group = ("list_no", "_r", "_q")
        found = probes.groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(match, schema)
        return top_k(found, k, descending=similarity).select("qid", "rank", "id", "dis")


def duplicate_groups(lists: DataFrame, code: str = "code") -> DataFrame:
    """(list_no, ids): rows of one list with equal codes, two or more."""
    return lists.groupBy("list_no", code).agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("list_no", "ids")


def deduplicate(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors under their smallest id, instances (id, instance))."""
    groups = base.groupBy("vec").agg(F.min("id").alias("id"))
    instances = base.select("vec", F.col("id").alias("instance")).join(groups, "vec").select("id", "instance")
    return groups, instances


def expand_instances(found: DataFrame, instances: DataFrame, k: int) -> DataFrame:
    """Search results over distinct vectors with all their instances in place, cut at k."""
    joined = found.select("qid", "id", "dis", F.col("rank").alias("_r")).join(instances, "id")
    order = Window.partitionBy("qid").orderBy("_r", "instance")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", F.col("instance").alias("id"), "dis")


def refine(found: DataFrame, queries: DataFrame, base: DataFrame, k: int, which: str = "l2") -> DataFrame:
    """Rerank candidates (qid, id) by the exact distance."""
    m = D.metric(which)
    exact = found.select("qid", "id").join(queries, "qid").join(base.select("id", "vec"), "id").select("qid", "id", m(F.col("qvec"), F.col("vec")).alias("dis"))
    return top_k(exact, k, descending=m.similarity).select("qid", "rank", "id", "dis")


def knn_refined(queries: DataFrame, coded_queries: DataFrame, coded: DataFrame, base: DataFrame, k: int, wide: int, which: str = "l2") -> DataFrame:
    """:func:`refine` of the ``wide`` best by code (of ``coded_queries`` against ``coded``), without making all of these.

    The k best of all rows are what refinement finds wherever they are among the ``wide`` best by code: how many
    rows the codes put ahead of the last of them is counted in blocks. Queries where that doesn't hold are
    searched by code and refined. ``coded`` has the ids of ``base``.
    """
    m = D.metric(which)
    kernel, plain = kernel_of(m), lambda q, b: all_pairs(q, b, m)
    coded = materialize(coded.select("id", "vec"), "codes")
    near = materialize(knn(queries, base, k, m), "near")
    key = F.col("dis")
    if m.similarity:  # the largest first: NaN, numbers
        key = F.when(F.isnan("dis"), F.lit(float("-inf"))).otherwise(-key)
    last = distances_to(near.select("qid", "id"), coded_queries, coded, m).groupBy("qid").agg(F.max(F.struct(key.alias("k"), "id")).alias("last"))
    edges = materialize(coded_queries.join(last, "qid").select("qid", "qvec", F.col("last.k").alias("edge"), F.col("last.id").alias("edge_id")), "edges")
    regular = edges.where(F.col("edge").isNotNull())
    sure = materialize(ahead(regular, coded, kernel, plain).where(F.col("n") < wide).select("qid"), "sure")
    rest = coded_queries.join(sure, "qid", "left_anti")
    if rest.isEmpty():
        return near
    found = refine(knn(rest, coded, wide, m), queries, base, k, which)
    return near.join(sure, "qid", "left_semi").unionByName(found)


def refine_range(found: DataFrame, queries: DataFrame, base: DataFrame, which: str = "l2") -> DataFrame:
    """Range results with exact distances; the radius isn't applied again."""
    m = D.metric(which)
    return found.select("qid", "id").join(queries, "qid").join(base.select("id", "vec"), "id").select("qid", "id", m(F.col("qvec"), F.col("vec")).alias("dis"))


def multi_index_probe(queries: DataFrame, books: list[np.ndarray], nprobe: int) -> DataFrame:
    """(qid, list_no, dis): best cells of the product of sub-codebooks. Cell number: part codes of ``bits`` bits each."""
    bits = max(1, int(np.ceil(np.log2(max(len(b) for b in books)))))
    found, start = None, 0
    for s, b in enumerate(books):
        part = F.slice(D.as_double(F.col("qvec")), start + 1, b.shape[1])
        start += b.shape[1]
        table = F.array(*[F.struct(D.l2(part, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(j).cast("long").alias("j")) for j, c in enumerate(b)])
        mine = queries.select("qid", F.explode(F.slice(F.array_sort(table), 1, nprobe)).alias("p")).select("qid", F.col("p.d").alias(f"d{s}"), F.shiftleft("p.j", s * bits).alias(f"j{s}"))
        found = mine if found is None else found.join(mine, "qid")
    n = len(books)
    total = F.lit(0.0)
    for s in range(n):
        total = total + F.col(f"d{s}")
    cell = F.col("j0")
    for s in range(1, n):
        cell = cell.bitwiseOR(F.col(f"j{s}"))
    return top_k(found.select("qid", cell.alias("list_no"), total.alias("dis")), nprobe, tie="list_no").withColumnRenamed("rank", "probe")


def split_nearest(queries: DataFrame, parts: list[DataFrame], widths: list[int]) -> DataFrame:
    """(qid, id, dis): nearest in each sub-space by itself; the id is the mixed-radix number of the parts' ids, k = 1.

    ``parts`` are (id, vec) tables with ids from 0.
    """
    found, start, radix = None, 0, 1
    for s, (part, width) in enumerate(zip(parts, widths, strict=True)):
        q = queries.select("qid", F.slice(D.as_double(F.col("qvec")), start + 1, width).alias("_q"))
        start += width
        pairs = part.crossJoin(q).withColumn("_d", D.l2(F.col("_q"), F.col("vec")))
        best = pairs.groupBy("qid").agg(F.min(F.struct("_d", "id")).alias("b")).select("qid", F.col("b._d").alias(f"d{s}"), (F.col("b.id") * radix).alias(f"i{s}"))
        radix *= part.count()
        found = best if found is None else found.join(best, "qid")
    total, number = F.lit(0.0), F.lit(0)
    for s in range(len(parts)):
        total, number = total + F.col(f"d{s}"), number + F.col(f"i{s}")
    return found.select("qid", number.cast("long").alias("id"), total.alias("dis"))


def knn_1d(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Nearest numbers by |x - q|; equal gaps go to the right side, then to the smaller id. Columns q and x."""
    pairs = base.crossJoin(queries).select("qid", "id", F.abs(F.col("x") - F.col("q")).alias("dis"), (F.col("x") < F.col("q")).cast("int").alias("_left"))
    order = Window.partitionBy("qid").orderBy("dis", "_left", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dis")


def with_centroids(index: Inverted, base: DataFrame, centroids: np.ndarray) -> Inverted:
    """The same rows under another coarse quantizer."""
    return Inverted.build(base, centroids, index.which, index.residual)


def search_two_views(queries: DataFrame, base: DataFrame, centroids: np.ndarray, k: int, nprobe: int, which: str = "l2") -> DataFrame:
    """Lists by one vector column (``coarse_vec``, ``qcoarse``), distances by another (``vec``, ``qvec``)."""
    similarity = D.metric(which).similarity
    lists = assign_to(base, np.asarray(centroids, float), "coarse_vec", similarity).drop("dis", "coarse_vec")
    table = base.sparkSession.createDataFrame([(i, np.asarray(c, float).tolist()) for i, c in enumerate(centroids)], "list_no int, centroid array<double>")
    probes = probe(queries.select("qid", F.col("qcoarse").alias("qvec")), table, nprobe, which).select("qid", "list_no")
    m = D.metric(which)

    def plain(q: DataFrame, rows: DataFrame) -> DataFrame:
        found = q.select("qid", "qvec", F.explode("lists").alias("list_no")).join(rows, "list_no")
        return found.select("qid", "id", m(F.col("qvec"), F.col("vec")).alias("dis"), "list_no")

    probing = probes.groupBy("qid").agg(F.collect_list("list_no").alias("lists")).join(queries.select("qid", "qvec"), "qid")
    kernel = kernel_of(m)
    found = plain(probing, lists) if kernel is None else pairs(materialize(probing, "probes"), materialize(lists.select("id", "vec", "list_no"), "lists"), kernel, plain, k=k)
    return top_k(found, k, descending=similarity).select("qid", "rank", "id", "dis")


def random_results(queries: DataFrame, n: int, k: int, seed: int = 1234) -> DataFrame:
    """k pseudo-random ids below ``n`` for each query, with increasing distances: a stand-in for tests."""
    from vectrill.functions.random import integers, uniform

    ranks = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    step = ranks.select("qid", "rank", integers(seed, n, F.col("qid"), F.col("rank")).alias("id"), uniform(seed + 1, F.col("qid"), F.col("rank")).alias("_s"))
    w = Window.partitionBy("qid").orderBy("rank")
    return step.select("qid", "rank", "id", F.sum("_s").over(w).alias("dis"))
