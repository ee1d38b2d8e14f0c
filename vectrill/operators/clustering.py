"""k-means and its variants.

Rows stay distributed: every iteration assigns them to broadcast centroids (k x d numbers) and sums them per partition,
so that only k x d sums are gathered. Centroids may be rounded after each update (``digits``), which makes a run the
same on any partitioning and lets SQL replay it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.functions import distances as D
from vectrill.operators.transforms import PCA, sample_matrix


#: Up to so many numbers of centroids are written into an expression; more are sent to Arrow batches.
INLINE = 1024
#: Rows times centroids that are compared at a time in a task.
PRODUCTS = 1 << 22


def nearest(x: np.ndarray, c: np.ndarray, norms: np.ndarray, similarity: bool = False, products: int = PRODUCTS) -> np.ndarray:
    """The number of each row's nearest centroid (the smaller of equals), by blocks of rows and of centroids."""
    wide = min(len(c), max(1, products // 64))
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), max(1, products // wide)):
        part = x[at : at + max(1, products // wide)]
        best, where = np.full(len(part), np.inf), np.zeros(len(part), np.int64)
        for left in range(0, len(c), wide):
            d = part @ c[left : left + wide].T
            d = -d if similarity else norms[left : left + wide] - 2 * d
            near = d.argmin(axis=1)
            least = d[np.arange(len(part)), near]
            better = least < best
            best[better], where[better] = least[better], left + near[better]
        out[at : at + len(part)] = where
    return out


def _gaps(x: np.ndarray, c: np.ndarray, near: np.ndarray, similarity: bool) -> np.ndarray:
    return np.einsum("ij,ij->i", x, c[near]) if similarity else ((x - c[near]) ** 2).sum(axis=1)


def _assign_batches(df: DataFrame, centroids: np.ndarray, vec: str, similarity: bool, name: str) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in (name, "dis")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(name, T.IntegerType()), T.StructField("dis", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        norms = (c * c).sum(axis=1)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            near = nearest(x, c, norms, similarity)
            dis = _gaps(x, c, near, similarity)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(near.astype(np.int32)), pa.array(dis)], names=[*names, name, "dis"])

    return df.where(F.col(vec).isNotNull()).select(*names).mapInArrow(run, schema)


def assign_to(df: DataFrame, centroids: np.ndarray, vec: str = "vec", similarity: bool = False, name: str = "list_no") -> DataFrame:
    """``df`` with the number of the nearest centroid (the smaller of equals) and ``dis``: as expressions for few
    centroids, by matrix products in Arrow batches for many."""
    centroids = np.asarray(centroids, float)
    if centroids.size > INLINE:
        return _assign_batches(df, centroids, vec, similarity, name)
    v = D.as_double(F.col(vec))
    f = D.inner_product if similarity else D.l2
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    scored = F.transform(rows, lambda c, i: F.struct((-f(v, c) if similarity else f(v, c)).alias("d"), i.alias("i")))
    best = F.array_min(scored)
    return df.withColumn("_best", best).withColumn(name, F.col("_best.i")).withColumn("dis", -F.col("_best.d") if similarity else F.col("_best.d")).drop("_best")


def split_empty(centroids: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> int:
    """Empty clusters take half of a donor, chosen in proportion to its size; returns how many were split."""
    n, k, done = sizes.sum(), len(sizes), 0
    wave = np.where(np.arange(centroids.shape[1]) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024)
    for empty in np.flatnonzero(sizes == 0):
        chance = np.maximum(sizes - 1, 0)
        if chance.sum() <= 0 or n <= k:
            break
        donor = rng.choice(k, p=chance / chance.sum())
        centroids[empty] = centroids[donor] * wave
        centroids[donor] = centroids[donor] / wave
        sizes[empty] = sizes[donor] // 2
        sizes[donor] -= sizes[empty]
        done += 1
    return done


@dataclass
class KMeans:
    """Lloyd's algorithm. ``stats`` has (objective, imbalance, splits) of each iteration of the best run."""

    k: int
    rounds: int = 25
    redo: int = 1
    seed: int = 1234
    spherical: bool = False
    round_to_int: bool = False
    similarity: bool = False
    start: np.ndarray | None = None
    frozen: int = 0
    init: str = "random"  # or "k-means++", "afk-mc2"
    digits: int | None = None
    most_points: int = 256
    update_empty: bool = True
    decode: Callable[[DataFrame], DataFrame] | None = None
    centroids: np.ndarray | None = None
    stats: list[tuple[float, float, int]] = field(default_factory=list)

    def _finish(self, c: np.ndarray) -> np.ndarray:
        if self.spherical:
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        if self.round_to_int:
            c = np.rint(c)
        return c if self.digits is None else np.round(c, self.digits)

    def _initial(self, df: DataFrame, vec: str, seed: int) -> np.ndarray:
        if self.start is not None and len(self.start) == self.k:
            return self.start.astype(float).copy()
        x = sample_matrix(df, vec, max(self.k, self.most_points * self.k))
        if len(x) < self.k:
            raise ValueError(f"{self.k} clusters need at least as many vectors; there are {len(x)}")
        rng = np.random.default_rng(seed)
        fixed = [] if self.start is None else list(self.start)
        return initial_centroids(x, self.k, self.init, rng, fixed)

    def fit(self, df: DataFrame, vec: str = "vec", weight: str | None = None) -> KMeans:
        if self.decode is not None:
            df = self.decode(df)
        best = None
        for attempt in range(self.redo):
            c, stats = self._run(df, vec, weight, self.seed + attempt)
            if best is None or (stats[-1][0] > best[1][-1][0] if self.similarity else stats[-1][0] < best[1][-1][0]):
                best = (c, stats)
        self.centroids, self.stats = best
        return self

    def _run(self, df: DataFrame, vec: str, weight: str | None, seed: int) -> tuple[np.ndarray, list]:
        c = self._finish(self._initial(df, vec, seed))
        rng, stats = np.random.default_rng(seed), []
        for _ in range(self.rounds):
            sums, sizes, objective = _sums(df, c, vec, weight, self.similarity)
            new = c.copy()
            some = sizes > 0
            some[: self.frozen] = False
            new[some] = sums[some] / sizes[some, None]
            splits = split_empty(new, sizes.copy(), rng) if self.update_empty else 0
            total = sizes.sum()
            stats.append((objective, float(len(sizes) * (sizes**2).sum() / total**2) if total else 0.0, splits))
            new = self._finish(new)
            new[: self.frozen] = c[: self.frozen]
            done = len(stats) > 1 and stats[-1][0] == stats[-2][0]
            c = new
            if done:
                break
        return c, stats or [(0.0, 0.0, 0)]

    def assign(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return assign_to(df, self.centroids, vec, self.similarity)

    def table(self, df: DataFrame) -> DataFrame:
        """(list_no, centroid)."""
        return df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list_no int, centroid array<double>")


def initial_centroids(x: np.ndarray, k: int, how: str, rng: np.random.Generator, fixed: list | None = None) -> np.ndarray:
    chosen = list(fixed or [])
    if how == "random":
        order = rng.permutation(len(x))
        return np.array([*chosen, *x[order[: k - len(chosen)]]], float)
    if not chosen:
        chosen.append(x[rng.integers(len(x))])
    near = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
    if how == "k-means++":
        while len(chosen) < k:
            p = near / near.sum() if near.sum() > 0 else None
            chosen.append(x[rng.choice(len(x), p=p)])
            near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(axis=1))
    elif how == "afk-mc2":
        q = 0.5 * near / max(near.sum(), 1e-300) + 0.5 / len(x)
        q /= q.sum()
        dist = lambda i: min(float(((x[i] - c) ** 2).sum()) for c in chosen)
        while len(chosen) < k:
            i = rng.choice(len(x), p=q)
            di = dist(i)
            for j in rng.choice(len(x), 49, p=q):
                dj = dist(j)
                if di == 0 or dj * q[i] / (di * q[j]) > rng.random():
                    i, di = j, dj
            chosen.append(x[i])
    else:
        raise ValueError(f"no initialisation {how!r}")
    return np.array(chosen, float)


def _sums(df: DataFrame, c: np.ndarray, vec: str, weight: str | None, similarity: bool, search=nearest) -> tuple[np.ndarray, np.ndarray, float]:
    """Per cluster: weighted sum and weight; and the objective. One row per partition and cluster is gathered."""
    sent = df.sparkSession.sparkContext.broadcast(c)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        norms = (c * c).sum(axis=1)
        sums, sizes, objective = np.zeros_like(c), np.zeros(len(c)), 0.0
        for batch in batches:
            w = batch.column(1).to_numpy() if weight else np.ones(len(batch))
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            if np.isnan(x).any():
                raise ValueError("vectors with NaN components can't be clustered")
            near = search(x, c, norms, similarity)
            objective += float((w * _gaps(x, c, near, similarity)).sum())
            np.add.at(sums, near, x * w[:, None])
            np.add.at(sizes, near, w)
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some].tolist(), pa.list_(pa.float64())), pa.array(sizes[some]), pa.array(np.r_[objective, np.zeros(len(some) - 1)] if len(some) else np.zeros(0))], names=["k", "s", "n", "o"])

    columns = [vec] if weight is None else [vec, F.col(weight).cast("double").alias(weight)]
    rows = df.where(F.col(vec).isNotNull()).select(*columns).mapInArrow(partial, "k long, s array<double>, n double, o double")
    added = rows.select("k", F.posexplode("s").alias("i", "x"), "n", "o").groupBy("k", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("o").alias("o")).toArrow()
    sums, sizes = np.zeros_like(c), np.zeros(len(c))
    k, i = added.column("k").to_numpy(), added.column("i").to_numpy()
    sums[k, i] = added.column("x").to_numpy()
    sizes[k[i == 0]] = added.column("n").to_numpy()[i == 0]
    return sums, sizes, float(added.column("o").to_numpy()[i == 0].sum())


def fit_progressive(df: DataFrame, k: int, steps: int = 10, rounds: int = 10, vec: str = "vec", seed: int = 1234) -> KMeans:
    """k-means on growing numbers of principal axes, each started from the last."""
    d = len(df.select(vec).first()[0])
    pca = PCA(d).fit(df, vec)
    turned = pca.apply(df, vec).persist()
    start, model = None, None
    for step in range(steps):
        width = max(1, int(round(d ** ((step + 1) / steps))))
        part = turned.withColumn(vec, F.slice(vec, 1, width))
        if start is not None:
            start = np.pad(start, ((0, 0), (0, width - start.shape[1])))
        model = KMeans(k, rounds, seed=seed, start=start).fit(part, vec)
        start = model.centroids
    turned.unpersist()
    model.centroids = model.centroids @ pca.linear.matrix - pca.linear.matrix.T @ pca.linear.bias
    return model


def fit_two_level(df: DataFrame, k: int, rounds: int = 10, vec: str = "vec", seed: int = 1234, most_points: int = 256) -> np.ndarray:
    """About sqrt(k) coarse clusters, each divided in proportion to its size; k centroids.

    All clusters are divided at once: a round is one pass, in which a row is compared with the centroids of its own
    coarse cluster only. The first centroids come from a sample of ``most_points`` rows for each; a cluster with fewer
    sampled rows than its share gets so many.
    """
    coarse = max(1, int(np.sqrt(k)))
    first = KMeans(coarse, rounds, seed=seed).fit(df, vec).centroids
    sizes = _sums(df, first, vec, None, False)[1]
    want = np.diff(np.r_[0, np.rint(np.cumsum(sizes) * k / sizes.sum()).astype(int)])
    x = sample_matrix(df, vec, max(k, most_points * k))
    cell, rng = nearest(x, first, (first * first).sum(axis=1)), np.random.default_rng(seed)
    starts = [initial_centroids(x[cell == i], min(int(n), int((cell == i).sum())), "random", rng) for i, n in enumerate(want)]
    edges = np.r_[0, np.cumsum([len(part) for part in starts])]
    c = np.concatenate([part for part in starts if len(part)])
    # rows of a cluster without a share go to the nearest coarse cluster that has one
    divided = np.flatnonzero(np.diff(edges))
    search = _within(first[divided], edges[np.r_[divided, len(want)]])
    before = None
    for _ in range(rounds):
        sums, sizes, objective = _sums(df, c, vec, None, False, search)
        new, some = c.copy(), sizes > 0
        new[some] = sums[some] / sizes[some, None]
        for i in range(len(divided)):
            mine = slice(edges[divided[i]], edges[divided[i] + 1])
            split_empty(new[mine], sizes[mine].copy(), rng)
        c = new
        if objective == before:
            break
        before = objective
    return c


def _within(first: np.ndarray, edges: np.ndarray) -> Callable[..., np.ndarray]:
    """A search for the nearest centroid among those of the nearest of ``first``: ``edges`` tells where each one's begin."""
    lengths = (first * first).sum(axis=1)

    def search(x: np.ndarray, c: np.ndarray, norms: np.ndarray, similarity: bool = False) -> np.ndarray:
        cell = nearest(x, first, lengths)
        order = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[order], np.arange(len(first) + 1))
        out = np.empty(len(x), np.int64)
        for i in np.flatnonzero(np.diff(bounds)):
            rows, mine = order[bounds[i] : bounds[i + 1]], slice(edges[i], edges[i + 1])
            out[rows] = edges[i] + nearest(x[rows], c[mine], norms[mine], similarity)
        return out

    return search


def kmeans_1d(values: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Optimal centroids of numbers, by dynamic programming over the sorted values with divide and conquer."""
    x, at = np.unique(values, return_inverse=True)
    w = np.bincount(at, weights)
    k = min(k, len(x))
    n, s, q = (np.r_[0, np.cumsum(v)] for v in (w, w * x, w * x * x))

    def cost(a: np.ndarray, b: int) -> np.ndarray:  # of x[a:b]
        m = n[b] - n[a]
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / m

    best = cost(np.zeros(len(x), int), np.arange(1, len(x) + 1)) if len(x) else np.zeros(0)
    best = np.r_[0.0, best]
    cuts = []
    for layer in range(1, k):
        new, cut = np.full(len(x) + 1, np.inf), np.zeros(len(x) + 1, int)
        stack = [(layer + 1, len(x), layer, len(x) - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            options = np.arange(a, min(b, mid - 1) + 1)
            c = best[options] + cost(options, mid)
            j = int(c.argmin())
            new[mid], cut[mid] = c[j], options[j]
            stack += [(lo, mid - 1, a, int(options[j])), (mid + 1, hi, int(options[j]), b)]
        best = new
        cuts.append(cut)
    bounds, end = [len(x)], len(x)
    for cut in reversed(cuts):
        end = int(cut[end])
        bounds.append(end)
    bounds = [*bounds, 0][::-1] if bounds[-1] else bounds[::-1]
    return np.array([(s[b] - s[a]) / (n[b] - n[a]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


def fit_1d(df: DataFrame, column: str, k: int, most: int = 100_000) -> np.ndarray:
    """Optimal 1-D centroids from the weighted distinct values; more distinct values than ``most`` are an error."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")).limit(most + 1).toArrow()
    if len(counts) > most:
        raise ValueError(f"more than {most} distinct values; round them first")
    return kmeans_1d(counts.column("x").to_numpy(), k, counts.column("n").to_numpy())
