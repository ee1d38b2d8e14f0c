"""Codecs of single components: scalar quantizers, row-wise ranges, half precision, sign bits, spectral bits."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.functions import vectors as V
from vectrill.functions.distances import as_double
from vectrill.operators.stats import components


def _constant(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class ScalarQuantizer:
    """Components in steps of 2**bits over a range by dimension, or over one range (``uniform``).

    A component is scaled to [0, 1] and cut off there; the code is the integer part of (2**bits - 1) times that, and
    stands for the middle of its step.

    ``range_from``: "minmax" (widened on both sides by ``argument`` times the range), "meanstd" (``argument``
    deviations around the mean), "quantiles" (``argument`` cut off on each side), "optim" (least squares).
    """

    bits: int = 8
    uniform: bool = False
    range_from: str = "minmax"
    argument: float = 0.0
    digits: int | None = None
    low: list[float] = field(default_factory=list)
    width: list[float] = field(default_factory=list)

    @property
    def steps(self) -> int:
        return (1 << self.bits) - 1

    def fit(self, df: DataFrame, vec: str = "vec") -> ScalarQuantizer:
        rows = components(df, vec)
        keyed = rows.withColumn("i", F.lit(0)) if self.uniform else rows
        a = float(self.argument)
        if self.range_from in ("minmax", "optim"):
            span = F.max("x") - F.min("x")
            low, width = F.min("x") - span * a, span * (1 + 2 * a)
        elif self.range_from == "meanstd":
            mean, deviation = F.avg("x"), F.stddev_pop("x")
            low, width = mean - deviation * a, deviation * (2 * a)
        elif self.range_from == "quantiles":
            q0, q1 = F.percentile("x", F.lit(a)), F.percentile("x", F.lit(1 - a))
            low, width = q0, q1 - q0
        else:
            raise ValueError(f"no range {self.range_from!r}")
        cut = (lambda c: c) if self.digits is None else (lambda c: F.round(c, self.digits))
        found = keyed.groupBy("i").agg(cut(low).alias("low"), cut(width).alias("width")).orderBy("i").collect()
        self.low, self.width = [r["low"] for r in found], [r["width"] for r in found]
        if self.range_from == "optim":
            self._optimize(df, vec)
        return self

    def _optimize(self, df: DataFrame, vec: str, rounds: int = 20) -> None:
        """Alternate codes and the line that fits them best, from sums by dimension."""
        for _ in range(rounds):
            coded = self.encode(df, vec).select(F.posexplode(F.zip_with(as_double(F.col(vec)), F.col("code"), lambda x, c: F.struct(x.alias("x"), (c.cast("double") + 0.5).alias("c")))).alias("i", "p"))
            keyed = coded.select((F.lit(0) if self.uniform else F.col("i")).alias("i"), "p.x", "p.c")
            found = keyed.groupBy("i").agg(F.avg("c").alias("mc"), F.avg("x").alias("mx"), F.avg(F.col("c") * F.col("c")).alias("cc"), F.avg(F.col("c") * F.col("x")).alias("cx")).orderBy("i").collect()
            for k, r in enumerate(found):
                spread = r["cc"] - r["mc"] ** 2
                if spread > 1e-12:
                    slope = (r["cx"] - r["mc"] * r["mx"]) / spread
                    self.low[k], self.width[k] = r["mx"] - slope * r["mc"], slope * self.steps

    def _ranges(self, d: Column) -> tuple[Column, Column]:
        if self.uniform:
            return F.array_repeat(F.lit(float(self.low[0])), d), F.array_repeat(F.lit(float(self.width[0])), d)
        return _constant(self.low), _constant(self.width)

    def code(self, vec: Column) -> Column:
        low, width = self._ranges(F.size(vec))
        offset = F.zip_with(as_double(vec), low, lambda x, l: x - l)
        unit = F.zip_with(offset, width, lambda x, w: F.when(w == 0, F.lit(0.0)).otherwise(x / w))
        return F.transform(unit, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * self.steps).cast("int"))

    def value(self, code: Column) -> Column:
        low, width = self._ranges(F.size(code))
        scaled = F.zip_with(code, width, lambda c, w: (c.cast("double") + 0.5) / self.steps * w)
        return F.zip_with(low, scaled, lambda l, x: l + x)

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        return df.withColumn(code, self.code(F.col(vec)))

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        return df.withColumn(vec, self.value(F.col(code)))


@dataclass
class DirectBytes:
    """Components that are small integers already: 0 to 255, or -128 to 127 with ``signed``."""

    signed: bool = False

    def fit(self, df: DataFrame, vec: str = "vec") -> DirectBytes:
        return self

    def code(self, vec: Column) -> Column:
        return F.transform(as_double(vec), lambda x: (x + (128 if self.signed else 0)).cast("int"))

    def value(self, code: Column) -> Column:
        return F.transform(code, lambda c: c.cast("double") - (128 if self.signed else 0))

    encode, decode = ScalarQuantizer.encode, ScalarQuantizer.decode


@dataclass
class HalfPrecision:
    """16-bit floats, as integers of 16 bits: IEEE halves, or the upper half of a float (``brain``)."""

    brain: bool = False

    def fit(self, df: DataFrame, vec: str = "vec") -> HalfPrecision:
        return self

    def code(self, vec: Column) -> Column:
        brain = self.brain

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(v):
            return v.map(lambda x: (np.asarray(x, np.float32).view(np.uint32) >> 16 if brain else np.asarray(x, np.float16).view(np.uint16)).astype(np.int32))

        return encode(vec)

    def value(self, code: Column) -> Column:
        brain = self.brain

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def decode(v):
            return v.map(lambda c: ((np.asarray(c, np.uint32) << 16).view(np.float32) if brain else np.asarray(c, np.uint16).view(np.float16)).astype(np.float64))

        return decode(code)

    encode, decode = ScalarQuantizer.encode, ScalarQuantizer.decode


@dataclass
class RowMinMax:
    """Each row scaled to [0, 1] by itself, then coded by another codec; keeps (scale, low) with the row.

    A row of equal components has scale 0 and codes as zeros. It is a codec only; search decodes first.
    """

    inner: ScalarQuantizer = field(default_factory=lambda: ScalarQuantizer(low=[0.0], width=[1.0], uniform=True))

    def scaled(self, vec: Column) -> Column:
        v = as_double(vec)
        low, scale = F.array_min(v), F.array_max(v) - F.array_min(v)
        return F.transform(v, lambda x: F.when(scale == 0, F.lit(0.0)).otherwise((x - low) / scale))

    def fit(self, df: DataFrame, vec: str = "vec") -> RowMinMax:
        if self.inner.low != [0.0] or self.inner.width != [1.0]:
            self.inner.fit(df.withColumn(vec, self.scaled(F.col(vec))), vec)
        return self

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        v = as_double(F.col(vec))
        return df.withColumn("scale", F.array_max(v) - F.array_min(v)).withColumn("low", F.array_min(v)).withColumn(code, self.inner.code(self.scaled(F.col(vec))))

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        return df.withColumn(vec, F.transform(self.inner.value(F.col(code)), lambda x: x * F.col("scale") + F.col("low")))


@dataclass
class SignBits:
    """Sign bits after an optional rotation, against 0 or the training medians; packed in 64-bit words."""

    n_bits: int
    rotation: object | None = None
    medians: bool = False
    digits: int | None = None
    thresholds: list[float] = field(default_factory=list)

    def _prepared(self, df: DataFrame, vec: str) -> DataFrame:
        return self.rotation.apply(df, vec) if self.rotation is not None else df.withColumn(vec, F.slice(as_double(F.col(vec)), 1, self.n_bits))

    def fit(self, df: DataFrame, vec: str = "vec") -> SignBits:
        if self.medians:
            m = F.percentile("x", F.lit(0.5))
            found = components(self._prepared(df, vec), vec).groupBy("i").agg((m if self.digits is None else F.round(m, self.digits)).alias("m")).orderBy("i").collect()
            self.thresholds = [r["m"] for r in found]
        return self

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        at = self.thresholds or [0.0] * self.n_bits
        work = self._prepared(df.withColumn("_v", F.col(vec)), "_v")
        bits = V.bits_of(V.subtract(F.col("_v"), _constant(at)))
        return work.withColumn(code, V.pack_words(bits, self.n_bits)).drop("_v")

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        return df.withColumn(vec, V.signs_of(V.unpack_words(F.col(code), self.n_bits)))


@dataclass
class SpectralBits:
    """Parity of floor((x - c) * 2 / period) for each component; ``period`` below 0 is a plain threshold at c.

    ``center`` is a column with the list's thresholds (zeros, centroid, centroid - period / 4, or medians).
    """

    period: float = -1e10

    def bits(self, vec: Column, center: Column) -> Column:
        offset = V.subtract(vec, center)
        if self.period < 0:
            # floor(x * 2 / period) is 0 or -1: odd for positive components
            return F.transform(offset, lambda x: (x > 0).cast("int"))
        return F.transform(offset, lambda x: F.pmod(F.floor(x * (2.0 / self.period)), F.lit(2)).cast("int"))
