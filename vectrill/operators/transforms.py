"""Vector transforms: fitted on a DataFrame, applied as Column expressions (or in Arrow batches for wide matrices).

Fitted parameters are small arrays (d x d at most). Statistics are distributed aggregates; rotations come from numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators.stats import components

#: Matrices of more entries than this are applied by numpy in Arrow batches; smaller ones as expressions.
INLINE = 1024


class Transform:
    def fit(self, df: DataFrame, vec: str = "vec") -> Transform:
        return self

    def expression(self, vec: Column) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return df.withColumn(vec, self.expression(F.col(vec)))

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        raise ValueError(f"{type(self).__name__} can't be reversed")


def sample_matrix(df: DataFrame, vec: str = "vec", most: int = 65_536, id: str = "id") -> np.ndarray:
    """At most ``most`` vectors, those of the smallest hash of the id: the bound for all fitting on the driver."""
    key = F.xxhash64(id) if id in df.columns else F.xxhash64(vec)
    rows = df.where(F.col(vec).isNotNull()).select(D.as_double(F.col(vec)).alias("v"), key.alias("h")).orderBy("h", "v").limit(most).toArrow()
    return np.array(rows.column("v").to_pylist(), np.float64).reshape(len(rows), -1)


@dataclass
class Linear(Transform):
    """y = A x + b."""

    matrix: np.ndarray
    bias: np.ndarray | None = None

    @property
    def _b(self) -> np.ndarray:
        return np.zeros(len(self.matrix)) if self.bias is None else self.bias

    def expression(self, vec: Column) -> Column:
        return V.matrix_times(self.matrix.tolist(), vec, self._b.tolist())

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return super().apply(df, vec) if self.matrix.size <= INLINE else apply_matrix(df, self.matrix, self._b, vec)

    @property
    def orthonormal(self) -> bool:
        a = self.matrix
        return a.shape[0] <= a.shape[1] and np.allclose(a @ a.T, np.eye(len(a)), atol=1e-5)

    def transposed(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """A' (y - b), whatever the matrix."""
        return apply_matrix(df, self.matrix.T, -self.matrix.T @ self._b, vec)

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        if not self.orthonormal:
            raise ValueError("only an orthonormal matrix can be reversed")
        return self.transposed(df, vec)


def apply_matrix(df: DataFrame, matrix: np.ndarray, bias: np.ndarray, vec: str = "vec") -> DataFrame:
    names = df.columns
    fields = [T.StructField(vec, T.ArrayType(T.DoubleType())) if f.name == vec else f for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vec)
            out = pa.nulls(len(batch), pa.list_(pa.float64()))
            known = column.drop_null()
            if len(known):
                x = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(known), -1)
                y = x @ matrix.T + bias
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                out = lists if len(known) == len(batch) else pa.array([next(it) if ok else None for it in [iter(lists.to_pylist())] for ok in column.is_valid().to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([out if n == vec else batch.column(n) for n in names], names=names)

    return df.mapInArrow(run, T.StructType(fields))


def random_rotation(d_in: int, d_out: int | None = None, seed: int = 1234) -> Linear:
    """Orthonormal rows (columns, if d_out > d_in) from a seed."""
    d_out = d_out or d_in
    n = max(d_in, d_out)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    q *= np.sign(np.diag(r))
    return Linear(q[:d_out, :d_in])


def mean_and_covariance(df: DataFrame, vec: str = "vec", id: str = "id") -> tuple[np.ndarray, np.ndarray, int]:
    """Exact, from partial sums of each partition: d and d x d numbers are gathered, whatever the rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            s = x.sum(axis=0) + (0 if s is None else s)
            ss = x.T @ x + (0 if ss is None else ss)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    sums = df.select(vec).mapInArrow(partial, "n long, s array<double>, ss array<double>")
    added = sums.select("n", F.posexplode(F.concat("s", "ss")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").toArrow()
    if not len(added):
        raise ValueError("no vectors to fit to")
    n, x = int(added.column("n")[0].as_py()), added.column("x").to_numpy()
    d = int((np.sqrt(1 + 4 * len(x)) - 1) / 2)
    mean = x[:d] / n
    return mean, x[d:].reshape(d, d) / n - np.outer(mean, mean), n


@dataclass
class PCA(Transform):
    """Projection on the leading eigenvectors of the covariance, with optional whitening and random rotation.

    ``power`` scales axis i by (eigenvalue + epsilon) ** power; -0.5 whitens. The sign of an axis is such that its
    component of largest size is positive.
    """

    d_out: int
    power: float = 0.0
    epsilon: float = 0.0
    rotate: bool = False
    linear: Linear | None = None
    eigenvalues: np.ndarray | None = None

    def fit(self, df: DataFrame, vec: str = "vec") -> PCA:
        mean, covariance, _ = mean_and_covariance(df, vec)
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        self.eigenvalues, axes = np.maximum(values[order], 0), axes[:, order].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        a = axes[: self.d_out]
        if self.power:
            a = a * ((self.eigenvalues[: self.d_out] + (0 if self.rotate else self.epsilon)) ** self.power)[:, None]
        if self.rotate:
            a = random_rotation(self.d_out).matrix @ a
        self.linear = Linear(a, -a @ mean)
        return self

    def expression(self, vec: Column) -> Column:
        return self.linear.expression(vec)

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return self.linear.apply(df, vec)

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return self.linear.reverse(df, vec)


@dataclass
class ITQ(Transform):
    """Iterative quantization: PCA, then a rotation that brings vectors near their signs."""

    d_out: int
    rounds: int = 50
    seed: int = 123
    linear: Linear | None = None

    def fit(self, df: DataFrame, vec: str = "vec") -> ITQ:
        x = sample_matrix(df, vec)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        mean = x.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov((x - mean).T, bias=True))
        p = axes[:, ::-1][:, : self.d_out].T
        y = (x - mean) @ p.T
        rotation = random_rotation(self.d_out, seed=self.seed).matrix
        for _ in range(self.rounds):
            signs = np.where(y @ rotation.T >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ y)
            rotation = u @ vt
        a = rotation @ p
        self.linear = Linear(a, -a @ mean)
        return self

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Vectors are normalised first."""
        return self.linear.apply(Normalize().apply(df, vec), vec)


@dataclass
class OPQ(Transform):
    """A rotation fitted together with a product quantizer, by turns."""

    m: int
    d_out: int | None = None
    rounds: int = 50
    most: int = 65_536
    linear: Linear | None = None

    def fit(self, df: DataFrame, vec: str = "vec") -> OPQ:
        from vectrill.operators.codecs.pq import encode_numpy, decode_numpy, train_numpy

        x = sample_matrix(df, vec, self.most)
        d = x.shape[1]
        d_out = self.d_out or d
        rotation = random_rotation(d, d_out).matrix
        bits = 8 if len(x) >= 256 else max(1, int(np.log2(max(2, len(x) // 2))))
        books = None
        for _ in range(self.rounds):
            y = x @ rotation.T
            books = train_numpy(y, self.m, bits, 4, start=books)
            near = decode_numpy(encode_numpy(y, books), books)
            u, _, vt = np.linalg.svd(near.T @ x, full_matrices=False)
            rotation = u @ vt
        self.linear = Linear(rotation)
        return self

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return self.linear.apply(df, vec)

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return self.linear.reverse(df, vec)


@dataclass
class Remap(Transform):
    """Output j is input ``positions[j]``; -1 pads with 0."""

    positions: list[int]

    @classmethod
    def pad(cls, d_in: int, d_out: int, uniform: bool = False) -> Remap:
        """To d_out dimensions: zeros (or a cut) at the end, or spread evenly."""
        if not uniform:
            return cls([i if i < d_in else -1 for i in range(d_out)])
        if d_in >= d_out:
            return cls([i * d_in // d_out for i in range(d_out)])
        positions = [-1] * d_out
        for i in range(d_in):
            positions[i * d_out // d_in] = i
        return cls(positions)

    def expression(self, vec: Column) -> Column:
        return V.remap(vec, self.positions)

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        back = [-1] * (max(self.positions, default=-1) + 1)
        for j, i in enumerate(self.positions):
            if i >= 0:
                back[i] = j
        return Remap(back).apply(df, vec)


@dataclass
class Normalize(Transform):
    def expression(self, vec: Column) -> Column:
        return D.normalized(vec)

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return df


@dataclass
class Center(Transform):
    """Subtracts the mean of the training vectors."""

    digits: int | None = None
    mean: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, vec: str = "vec") -> Center:
        mean = F.avg("x")
        rows = components(df, vec).groupBy("i").agg((mean if self.digits is None else F.round(mean, self.digits)).alias("m")).orderBy("i").collect()
        self.mean = [r["m"] for r in rows]
        return self

    def expression(self, vec: Column) -> Column:
        return V.subtract(vec, F.array(*[F.lit(m) for m in self.mean]))

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        return df.withColumn(vec, V.add(F.col(vec), F.array(*[F.lit(m) for m in self.mean])))


@dataclass
class Chain(Transform):
    """Transforms in a row. A radius of a later range search is not rescaled."""

    steps: list[Transform]

    def fit(self, df: DataFrame, vec: str = "vec") -> Chain:
        for step in self.steps:
            step.fit(df, vec)
            df = step.apply(df, vec)
        return self

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        for step in self.steps:
            df = step.apply(df, vec)
        return df

    def reverse(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        for step in reversed(self.steps):
            df = step.reverse(df, vec)
        return df
