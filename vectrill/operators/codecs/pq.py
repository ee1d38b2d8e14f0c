"""Quantizers with codebooks: product, residual, local search and two-layer codes.

Codebooks are fitted on a bounded sample on the driver and are small; encoding and decoding run over all rows, as
expressions where that is exact in SQL too, and with numpy in Arrow batches for speed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators.transforms import sample_matrix


def lloyd(x: np.ndarray, k: int, rounds: int = 25, seed: int = 1234, start: np.ndarray | None = None) -> np.ndarray:
    """k-means of a matrix on the driver. Empty clusters take over a half of the largest."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x)) or 1
    c = x[rng.permutation(len(x))[:k]].copy() if start is None else start.copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        some = n > 0
        c[some] = sums[some] / n[some, None]
        for empty in np.flatnonzero(~some):
            donor = int(n.argmax())
            jitter = np.where(np.arange(x.shape[1]) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024)
            c[empty], c[donor] = c[donor] * jitter, c[donor] / jitter
            n[empty] = n[donor] // 2
            n[donor] -= n[empty]
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    norms = (c * c).sum(axis=1)
    return np.concatenate([(norms - 2 * x[i : i + block] @ c.T).argmin(axis=1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def train_numpy(x: np.ndarray, m: int, bits: int, rounds: int = 25, start: list[np.ndarray] | None = None, shared: bool = False, hypercube: bool = False) -> list[np.ndarray]:
    d = x.shape[1]
    if d % m:
        raise ValueError(f"{d} dimensions do not divide into {m} parts")
    parts = [x[:, s * d // m : (s + 1) * d // m] for s in range(m)]
    if shared:
        return [lloyd(np.concatenate(parts), 1 << bits, rounds)] * m
    if hypercube:  # corners around the mean, scaled by the deviations, as a start
        start = []
        for p in parts:
            corners = ((np.arange(1 << bits)[:, None] >> np.arange(min(bits, p.shape[1]))) & 1) * 2.0 - 1
            c = np.tile(p.mean(axis=0), (1 << bits, 1))
            c[:, : corners.shape[1]] += corners * p.std(axis=0)[: corners.shape[1]]
            start.append(c)
    return [lloyd(p, 1 << bits, rounds, start=None if start is None else start[i]) for i, p in enumerate(parts)]


def encode_numpy(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])
    return np.column_stack([nearest(x[:, cuts[i] : cuts[i + 1]], b) for i, b in enumerate(books)])


def decode_numpy(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], axis=1)


def map_vectors(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], source: str, target: str, kind: T.DataType) -> DataFrame:
    """``target`` = ``f`` of the matrix of a batch's ``source`` arrays; other columns pass through. No NULL vectors."""
    names = [n for n in df.columns if n != target]
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField(target, T.ArrayType(kind))])
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(source).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            y = f(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()).cast(arrow))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], names=[*names, target])

    return df.mapInArrow(run, schema)


@dataclass
class ProductQuantizer:
    """``m`` parts of a vector, each as the number of its nearest centroid of ``2 ** bits``."""

    m: int
    bits: int = 8
    books: list[np.ndarray] | None = None
    how: str = "default"  # or shared, hypercube, hot_start

    def fit(self, df: DataFrame, vec: str = "vec", most: int = 65_536) -> ProductQuantizer:
        if self.how == "hot_start" and self.books is None:
            raise ValueError("a hot start needs codebooks")
        self.books = train_numpy(sample_matrix(df, vec, most), self.m, self.bits, start=self.books if self.how == "hot_start" else None, shared=self.how == "shared", hypercube=self.how == "hypercube")
        return self

    def part(self, vec: Column, i: int) -> Column:
        width = self.books[0].shape[1]
        return F.slice(D.as_double(vec), i * width + 1, width)

    def table(self, vec: Column, i: int, product: bool = False) -> Column:
        """Distances (inner products) of a vector's part to the centroids: one row of the look-up table."""
        part = self.part(vec, i)
        f = D.inner_product if product else D.l2
        return F.array(*[f(part, F.array(*[F.lit(float(x)) for x in c])) for c in self.books[i]])

    def code(self, vec: Column) -> Column:
        return F.array(*[V.argmin(self.table(vec, i)) for i in range(self.m)])

    def value(self, code: Column) -> Column:
        books = [F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in b]) for b in self.books]
        return F.flatten(F.array(*[F.element_at(b, code[i] + 1) for i, b in enumerate(books)]))

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        books = self.books
        return map_vectors(df, lambda x: encode_numpy(x.astype(np.float64), books), vec, code, T.IntegerType())

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        books = self.books
        return map_vectors(df, lambda c: decode_numpy(c, books), code, vec, T.DoubleType())

    def codebook(self, df: DataFrame) -> DataFrame:
        """(m, code, vec): the codebooks as a table."""
        rows = [(i, j, c.tolist()) for i, b in enumerate(self.books) for j, c in enumerate(b)]
        return df.sparkSession.createDataFrame(rows, "m int, code int, vec array<double>")

    def distances(self, tables: Column, code: Column) -> Column:
        """Sum of the look-up tables (an array of arrays) at a code."""
        return sum((F.element_at(tables[i], code[i] + 1) for i in range(self.m)), F.lit(0.0))


@dataclass
class ResidualQuantizer:
    """``m`` stages, each coding what the ones before leave; a beam keeps the best partial codes."""

    m: int
    bits: int = 8
    beam: int = 5
    books: list[np.ndarray] | None = None

    def fit(self, df: DataFrame, vec: str = "vec", most: int = 65_536, refine: int = 0) -> ResidualQuantizer:
        x = sample_matrix(df, vec, most)
        left, books = x, []
        for _ in range(self.m):
            books.append(lloyd(left, 1 << self.bits))
            self.books = books
            left = x - self.decode_numpy(self.encode_numpy(x))
        for _ in range(refine):  # least squares over all codebooks at once
            codes = self.encode_numpy(x)
            hot = np.concatenate([np.eye(len(b))[codes[:, i]] for i, b in enumerate(books)], axis=1)
            best = np.linalg.solve(hot.T @ hot + 1e-3 * np.eye(hot.shape[1]), hot.T @ x)
            cuts = np.cumsum([0, *map(len, books)])
            books = self.books = [best[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self

    def encode_numpy(self, x: np.ndarray) -> np.ndarray:
        left, codes, cost = x[:, None, :], np.zeros((len(x), 1, 0), np.int64), None
        for b in self.books:
            d = ((left[:, :, None, :] - b[None, None]) ** 2).sum(axis=3) if len(x) * left.shape[1] * b.size < 5e7 else None
            if d is None:  # in blocks of rows
                step = max(1, int(5e7 / (left.shape[1] * b.size)))
                d = np.concatenate([((left[i : i + step, :, None, :] - b[None, None]) ** 2).sum(axis=3) for i in range(0, len(x), step)])
            flat = d.reshape(len(x), -1)
            keep = min(self.beam, flat.shape[1])
            at = np.argsort(flat, axis=1, kind="stable")[:, :keep]
            parent, code = at // len(b), at % len(b)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None]], axis=2)
            left = np.take_along_axis(left, parent[:, :, None], 1) - b[code]
            cost = np.take_along_axis(flat, at, 1)
        return codes[np.arange(len(x)), cost.argmin(axis=1)] if cost is not None else codes[:, 0]

    def decode_numpy(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, i]] for i, b in enumerate(self.books[: codes.shape[1]]))

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        return map_vectors(df, lambda x: self.encode_numpy(x.astype(np.float64)), vec, code, T.IntegerType())

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        return map_vectors(df, lambda c: self.decode_numpy(c), code, vec, T.DoubleType())


@dataclass
class LocalSearchQuantizer(ResidualQuantizer):
    """Additive codes improved by iterated conditional modes from perturbed starts."""

    rounds: int = 8
    tries: int = 4
    seed: int = 1234

    def fit(self, df: DataFrame, vec: str = "vec", most: int = 16_384, refine: int = 0) -> LocalSearchQuantizer:
        super().fit(df, vec, most)
        x = sample_matrix(df, vec, most)
        for _ in range(self.rounds):
            codes = self.encode_numpy(x)
            hot = np.concatenate([np.eye(len(b))[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
            best = np.linalg.solve(hot.T @ hot + 1e-2 * np.eye(hot.shape[1]), hot.T @ x)
            cuts = np.cumsum([0, *map(len, self.books)])
            self.books = [best[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self

    def encode_numpy(self, x: np.ndarray) -> np.ndarray:
        best = super().encode_numpy(x)
        if len(self.books) < self.m or not len(x):
            return best
        cost = ((x - self.decode_numpy(best)) ** 2).sum(axis=1)
        rng = np.random.default_rng(self.seed)
        for t in range(self.tries):
            codes = best.copy()
            if t:
                at = rng.integers(0, self.m, len(x))
                codes[np.arange(len(x)), at] = rng.integers(0, [len(self.books[i]) for i in at])
            for _ in range(3):
                for i, b in enumerate(self.books):
                    codes[:, i] = nearest(x - self.decode_numpy(codes) + b[codes[:, i]], b)
            now = ((x - self.decode_numpy(codes)) ** 2).sum(axis=1)
            better = now < cost
            best[better], cost[better] = codes[better], now[better]
        return best


@dataclass
class SplitCodec:
    """Equal parts of a vector, each by a codec of its own (product-additive codes)."""

    parts: list[ResidualQuantizer]

    def fit(self, df: DataFrame, vec: str = "vec") -> SplitCodec:
        d = len(df.select(vec).first()[0])
        w = d // len(self.parts)
        for i, p in enumerate(self.parts):
            p.fit(df.withColumn(vec, F.slice(D.as_double(F.col(vec)), i * w + 1, w)), vec)
        return self

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        parts = self.parts
        return map_vectors(df, lambda x: np.concatenate([p.encode_numpy(y.astype(np.float64)) for p, y in zip(parts, np.split(x, len(parts), axis=1), strict=True)], axis=1), vec, code, T.IntegerType())

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        parts, cuts = self.parts, np.cumsum([0, *(p.m for p in self.parts)])
        return map_vectors(df, lambda c: np.concatenate([p.decode_numpy(c[:, a:b]) for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)], axis=1), code, vec, T.DoubleType())


def polysemous_order(book: np.ndarray, rounds: int = 20_000, seed: int = 1234) -> np.ndarray:
    """Centroid numbers rearranged by annealing so that their Hamming distances follow the real ones."""
    n = len(book)
    real = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    bits = np.array([[bin(i ^ j).count("1") for j in range(n)] for i in range(n)], float)
    goal = real / max(real.mean(), 1e-12) * bits.mean()
    weight = np.exp(-goal)
    rng, order = np.random.default_rng(seed), np.arange(n)
    heat = 0.7

    def cost(rows: np.ndarray, p: np.ndarray) -> float:
        return float((weight[rows] * (goal[rows] - bits[p[rows]][:, p]) ** 2).sum())

    for _ in range(rounds if n > 1 else 0):
        i, j = rng.choice(n, 2, replace=False)
        swapped = order.copy()
        swapped[[i, j]] = swapped[[j, i]]
        rows = np.array([i, j])
        change = cost(rows, swapped) - cost(rows, order)
        if change < 0 or rng.random() < heat:
            order = swapped
        heat *= 0.9997 if heat > 1e-4 else 0
    return order


@dataclass
class RefinedProduct:
    """A product quantizer, and a second one for what the first leaves; codes one after the other."""

    first: ProductQuantizer
    second: ProductQuantizer

    def fit(self, df: DataFrame, vec: str = "vec") -> RefinedProduct:
        self.first.fit(df, vec)
        books = self.first.books
        left = map_vectors(df, lambda x: x - decode_numpy(encode_numpy(x.astype(np.float64), books), books), vec, vec, T.DoubleType())
        self.second.fit(left, vec)
        return self

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        a, b = self.first.books, self.second.books

        def both(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.float64)
            codes = encode_numpy(x, a)
            return np.concatenate([codes, encode_numpy(x - decode_numpy(codes, a), b)], axis=1)

        return map_vectors(df, both, vec, code, T.IntegerType())

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        a, b, m = self.first.books, self.second.books, self.first.m
        return map_vectors(df, lambda c: decode_numpy(c[:, :m], a) + decode_numpy(c[:, m:], b), code, vec, T.DoubleType())
