"""Graph search: navigable small worlds, spread-out neighbour graphs, and the k-NN graph by neighbour descent.

Graphs are walked pointer by pointer, which needs random access. A table is therefore divided into shards by a hash of
the id; each task builds the graph of a shard of bounded size and searches it for all queries, and the results are
merged by a global top-k. The k-NN graph itself is made by joins and isn't bound to a shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.operators.topk import top_k
from vectrill.runtime import materialize


def _squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def _opposite(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return -(x @ q)


#: What graphs are made and walked by; the smaller, the nearer.
METRICS = {"l2": _squared, "ip": _opposite}


def best_first(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, entries: list[int], ef: int, which: str = "l2") -> list[tuple[float, int]]:
    """The ``ef`` nearest nodes found from the entries; stops when the nearest open node is beyond all of them."""
    measure, seen = METRICS[which], set(entries)
    first = measure(x[entries], q)
    open_, found = [(float(d), e) for d, e in zip(first, entries, strict=True)], [(-float(d), -e) for d, e in zip(first, entries, strict=True)]
    heapq.heapify(open_)
    heapq.heapify(found)
    while len(found) > ef:
        heapq.heappop(found)
    while open_:
        d, node = heapq.heappop(open_)
        if len(found) >= ef and d > -found[0][0]:
            break
        fresh = [int(n) for n in links[node] if n not in seen]
        seen.update(fresh)
        for dn, n in zip(measure(x[fresh], q) if fresh else (), fresh, strict=True):
            if len(found) < ef or dn < -found[0][0]:
                heapq.heappush(open_, (float(dn), n))
                heapq.heappush(found, (-float(dn), -n))
                if len(found) > ef:
                    heapq.heappop(found)
    return sorted((-d, -n) for d, n in found)


def all_within(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, found: list[tuple[float, int]], radius: float, which: str = "l2") -> list[tuple[float, int]]:
    """What is nearer than ``radius`` among the found nodes, and what links lead to from there within it."""
    measure, out = METRICS[which], [f for f in found if f[0] < radius]
    seen, open_ = {n for _, n in found}, [n for _, n in out]
    while open_:
        fresh = [int(n) for n in links[open_.pop()] if int(n) not in seen]
        seen.update(fresh)
        for d, n in zip(measure(x[fresh], q).tolist() if fresh else (), fresh, strict=True):
            if d < radius:
                out.append((d, n))
                open_.append(n)
    return sorted(out)


def spread_out(x: np.ndarray, candidates: list[tuple[float, int]], most: int, which: str = "l2") -> list[int]:
    """From near to far, those that aren't nearer to one already kept than to the node itself."""
    kept: list[int] = []
    for d, n in candidates:
        if len(kept) >= most:
            break
        if not kept or (METRICS[which](x[kept], x[n]) >= d).all():
            kept.append(n)
    return kept


@dataclass
class SmallWorld:
    """A hierarchy of proximity graphs: 2 m links on the lowest level, m above."""

    m: int = 16
    ef_build: int = 40
    seed: int = 1234
    x: np.ndarray | None = None
    levels: np.ndarray | None = None
    links: list[list[np.ndarray]] = field(default_factory=list)
    entry: int = 0
    which: str = "l2"

    def build(self, x: np.ndarray) -> SmallWorld:
        self.x = np.asarray(x, float)
        n = len(self.x)
        self.levels = np.minimum((-np.log(1 - np.random.default_rng(self.seed).random(n)) / np.log(self.m)).astype(int), 12)
        top = int(self.levels.max()) if n else 0
        self.links = [[np.zeros(0, int)] * n for _ in range(top + 1)]
        order = np.argsort(-self.levels, kind="stable")
        for count, i in enumerate(order):
            if count == 0:
                self.entry = int(i)
                continue
            at = [self.entry]
            for level in range(top, -1, -1):
                if level > self.levels[i]:
                    at = [best_first(self.x, self.links[level], self.x[i], at, 1, self.which)[0][1]]
                    continue
                near = best_first(self.x, self.links[level], self.x[i], at, self.ef_build, self.which)
                most = 2 * self.m if level == 0 else self.m
                chosen = spread_out(self.x, near, most, self.which)
                self.links[level][i] = np.array(chosen)
                for c in chosen:
                    self._link_back(level, c, int(i), most)
                at = [b for _, b in near]
        return self

    def _link_back(self, level: int, node: int, new: int, most: int) -> None:
        have = np.append(self.links[level][node], new)
        if len(have) > most:
            d = METRICS[self.which](self.x[have], self.x[node])
            have = np.array(spread_out(self.x, sorted(zip(d.tolist(), have.tolist(), strict=True)), most, self.which))
        self.links[level][node] = have

    def search(self, q: np.ndarray, k: int, ef: int = 16) -> list[tuple[float, int]]:
        at = [self.entry]
        for level in range(len(self.links) - 1, 0, -1):
            at = [best_first(self.x, self.links[level], q, at, 1, self.which)[0][1]]
        return best_first(self.x, self.links[0], q, at, max(ef, k), self.which)[:k]

    def within(self, q: np.ndarray, radius: float, ef: int = 16) -> list[tuple[float, int]]:
        return all_within(self.x, self.links[0], q, self.search(q, ef, ef), radius, self.which)

    def edges(self, ids: np.ndarray) -> pd.DataFrame:
        rows = [(ids[s], level, r, ids[t]) for level, table in enumerate(self.links) for s, targets in enumerate(table) for r, t in enumerate(targets)]
        return pd.DataFrame(rows, columns=["src", "level", "rank", "dst"])


def own_neighbours(x: np.ndarray, most: int, which: str = "l2", block: int = 512) -> list[np.ndarray]:
    """The ``most`` nearest other rows of each row, by matrix products of blocks of rows."""
    norms, near = np.einsum("ij,ij->i", x, x), []
    for at in range(0, len(x), block):
        d = -(x[at : at + block] @ x.T)
        if which == "l2":
            d = norms[None] + 2 * d
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf  # by inner product a row need not be the nearest to itself
        some = np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(x) - 1 else np.argsort(d, axis=1, kind="stable")[:, : len(x) - 1]
        order = np.take_along_axis(d, some, 1).argsort(axis=1, kind="stable")
        near.extend(np.take_along_axis(some, order, 1))
    return near


@dataclass
class SpreadGraph:
    """One level of spread-out links made from a k-NN graph, entered at the node nearest to the mean."""

    r: int = 32
    candidates: int = 64
    x: np.ndarray | None = None
    links: list[np.ndarray] = field(default_factory=list)
    entry: int = 0
    which: str = "l2"

    def build(self, x: np.ndarray, near: list[np.ndarray] | None = None) -> SpreadGraph:
        self.x = np.asarray(x, float)
        n = len(self.x)
        if near is None:
            near = own_neighbours(self.x, self.candidates, self.which)
        self.entry = int(METRICS[self.which](self.x, self.x.mean(axis=0)).argmin()) if n else 0
        pruned = []
        for i in range(n):
            walked = best_first(self.x, near, self.x[i], [self.entry], self.candidates, self.which) if n > 1 else []
            pool = {int(j): float(d) for d, j in walked if j != i}
            pool.update(zip(map(int, near[i]), METRICS[self.which](self.x[near[i]], self.x[i]).tolist(), strict=True) if len(near[i]) else ())
            pruned.append(spread_out(self.x, sorted((d, j) for j, d in pool.items())[: self.candidates], self.r, self.which))
        sets = [list(p) for p in pruned]
        for i, p in enumerate(pruned):
            for j in p:
                if i not in sets[j]:
                    sets[j].append(i)
                    if len(sets[j]) > self.r:
                        d = METRICS[self.which](self.x[sets[j]], self.x[j])
                        sets[j] = spread_out(self.x, sorted(zip(d.tolist(), sets[j], strict=True)), self.r, self.which)
        self.links = [np.array(s, int) for s in sets]
        self._connect()
        return self

    def _connect(self) -> None:
        """Nodes out of reach of the entry are linked from their nearest reached node."""
        reached, stack = {self.entry}, [self.entry]
        for lost in [None, *range(len(self.links))]:
            if lost is not None and lost not in reached:
                inside = np.fromiter(reached, int)
                host = int(inside[METRICS[self.which](self.x[inside], self.x[lost]).argmin()])
                self.links[host] = np.append(self.links[host], lost)
                reached.add(lost)
                stack.append(lost)
            while stack:
                for t in self.links[stack.pop()]:
                    if int(t) not in reached:
                        reached.add(int(t))
                        stack.append(int(t))

    def search(self, q: np.ndarray, k: int, ef: int = 16) -> list[tuple[float, int]]:
        return best_first(self.x, self.links, q, [self.entry], max(ef, k), self.which)[:k]


    def within(self, q: np.ndarray, radius: float, ef: int = 16) -> list[tuple[float, int]]:
        return all_within(self.x, self.links, q, self.search(q, ef, ef), radius, self.which)


#: Tables are dealt to all cores as long as shards keep so many rows.
SHARD_LEAST = 1_000


def shard_count(base: DataFrame, n: int, shard_rows: int) -> int:
    """Shards of ``n`` rows: of ``shard_rows`` at most, and two a core unless they get small.

    One shard of a mid-sized table would be one task, while the other cores wait.
    """
    return max(1, -(-n // shard_rows), min(2 * base.sparkSession.sparkContext.defaultParallelism, n // SHARD_LEAST))


def graph_knn(queries: DataFrame, base: DataFrame, k: int, ef: int = 64, kind: str = "hnsw", m: int = 16, shard_rows: int = 100_000, most_queries: int = 20_000, which: str = "l2") -> DataFrame:
    """k-NN by a graph per shard; a shard has about ``shard_rows`` rows. ``kind``: hnsw or nsg; ``which``: l2 or ip.

    Queries are sent to all tasks, in several passes beyond ``most_queries``.
    """
    found = _by_shards(queries, base, lambda g, q: g.search(q, k, ef), kind, m, shard_rows, most_queries, which)
    return top_k(found, k, descending=which == "ip").select("qid", "rank", "id", "dis")


def graph_range(queries: DataFrame, base: DataFrame, radius: float, ef: int = 64, kind: str = "hnsw", m: int = 16, shard_rows: int = 100_000, most_queries: int = 20_000, which: str = "l2") -> DataFrame:
    """(qid, id, dis): rows strictly nearer than ``radius`` (more similar, for ip) that the graphs lead to, as in :func:`graph_knn`.

    From the ``ef`` nearest nodes found, links are followed as long as they stay within the radius.
    """
    bound = -radius if which == "ip" else radius
    return _by_shards(queries, base, lambda g, q: g.within(q, bound, ef), kind, m, shard_rows, most_queries, which)


def _by_shards(queries: DataFrame, base: DataFrame, ask, kind: str, m: int, shard_rows: int, most_queries: int, which: str) -> DataFrame:
    if which not in METRICS:
        raise ValueError(f"no graph search by {which}")
    n = base.count()
    shards = shard_count(base, n, shard_rows)
    blocks = max(1, -(-queries.count() // most_queries))
    spark, found = base.sparkSession, None
    # shards are placed by their number, so that no two of them meet in a task by chance
    sharded = base.select("id", D.as_double(F.col("vec")).alias("vec"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("_shard")).repartitionByRange(shards, "_shard")
    for b in range(blocks):
        part = queries.select("qid", D.as_double(F.col("qvec")).alias("qvec")).where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast((part["qid"].to_numpy(), [np.asarray(v) for v in part["qvec"]]))

        mine = sharded.groupBy("_shard").applyInPandas(_shard_search(sent, ask, kind, m, which), "qid long, id long, dis double")
        found = mine if found is None else found.union(mine)
    return found


def _shard_search(sent, ask, kind: str, m: int, which: str):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, ids = np.stack(rows["vec"].to_numpy()), rows["id"].to_numpy()
        graph = (SmallWorld(m, which=which) if kind == "hnsw" else SpreadGraph(2 * m, which=which)).build(x)
        sign = -1.0 if which == "ip" else 1.0
        out = [(qid, ids[i], sign * d) for qid, q in zip(*sent.value, strict=True) for d, i in ask(graph, q)]
        return pd.DataFrame(out, columns=["qid", "id", "dis"])

    return search


def build_edges(base: DataFrame, m: int = 16, shard_rows: int = 100_000) -> DataFrame:
    """(shard, src, level, rank, dst): the links of each shard's graph, to be kept as a table."""
    shards = max(1, -(-base.count() // shard_rows))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        edges = SmallWorld(m).build(np.stack(rows["vec"].to_numpy())).edges(rows["id"].to_numpy())
        edges.insert(0, "shard", int(rows["_shard"].iloc[0]))
        return edges

    sharded = base.select("id", D.as_double(F.col("vec")).alias("vec"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("_shard"))
    return sharded.groupBy("_shard").applyInPandas(build, "shard int, src long, level int, rank int, dst long")


def neighbour_descent(base: DataFrame, k: int, rounds: int = 8, sample: int = 10, settle: float = 0.001, pool: int = 10) -> DataFrame:
    """(src, rank, dst, dis): an approximate k-NN graph; neighbours of neighbours are tried until few are better.

    A round joins, at every node, up to ``sample`` new links (out and in) with each other and with the old ones.
    Work of a node is bounded by the sample, also where many point to it.
    """
    wide = k + pool
    vectors = base.select("id", D.as_double(F.col("vec")).alias("vec"))
    n = base.count()

    def measured(pairs: DataFrame) -> DataFrame:
        a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("_x"))
        b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("_y"))
        return pairs.join(a, "src").join(b, "dst").select("src", "dst", D.l2(F.col("_x"), F.col("_y")).alias("dis"))

    # a start from the members of buckets of two unrelated hashes, so that the buckets hang together
    buckets, links = max(1, n // wide), None
    for seed in (7, 8):
        start = vectors.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)).alias("_b"))
        found = start.select(F.col("id").alias("src"), "_b").join(start.select(F.col("id").alias("dst"), "_b"), "_b").where("src <> dst").select("src", "dst")
        links = found if links is None else links.union(found).distinct()
    graph = materialize(_keep(measured(links), wide).withColumn("new", F.lit(True)), "graph")
    for _ in range(rounds):
        near = Window.partitionBy("at").orderBy("_new_first", "dis", "other")
        both = graph.select(F.col("src").alias("at"), F.col("dst").alias("other"), "dis", "new").union(graph.select(F.col("dst").alias("at"), F.col("src").alias("other"), "dis", "new"))
        both = both.groupBy("at", "other").agg(F.min("dis").alias("dis"), F.max("new").alias("new")).withColumn("_new_first", (~F.col("new")).cast("int"))
        both = both.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= 2 * sample)
        left = both.select("at", F.col("other").alias("src"), F.col("new").alias("_a"))
        right = both.select("at", F.col("other").alias("dst"), F.col("new").alias("_b"))
        tried = left.join(right, "at").where("src <> dst and (_a or _b)").select("src", "dst").distinct()
        old = graph.select("src", "dst", F.lit(True).alias("_known"))
        fresh = measured(tried.join(graph.select("src", "dst"), ["src", "dst"], "left_anti"))
        merged = _keep(graph.select("src", "dst", "dis").unionByName(fresh), wide)
        graph_next = materialize(merged.join(old, ["src", "dst"], "left").select("src", "dst", "dis", F.col("_known").isNull().alias("new")), "graph")
        changed = graph_next.where("new").count()
        graph = graph_next
        if changed < settle * n * k:
            break
    ranked = top_k(graph, k, query="src", tie="dst")
    return ranked.select("src", "rank", "dst", "dis")


def _keep(edges: DataFrame, most: int) -> DataFrame:
    return top_k(edges, most, query="src", tie="dst").select("src", "dst", "dis")
