"""Random-rotation bit codes: signs of a residual with factors that give an unbiased estimate of the distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators import blocks as K
from vectrill.operators.topk import top_k
from vectrill.runtime import materialize


def encode(df: DataFrame, center: Column, vec: str = "vec", bits: int = 1) -> DataFrame:
    """``df`` with ``bits`` (0 or 1; with more bits, levels), ``or_c`` (squared distance to the centre), ``ip_oc``
    (inner product norm ‖x-c‖² - ‖x‖²) and ``multiplier``.

    With one bit a component is coded by the sign of its residual, 1 if it is over 0. More bits code its size in steps
    of the row's largest component.
    """
    v, d = D.as_double(F.col(vec)), F.size(vec).cast("double")
    work = df.withColumn("_r", V.subtract(v, center)).withColumn("or_c", D.norm_squared(F.col("_r")))
    work = work.withColumn("ip_oc", F.col("or_c") - D.norm_squared(F.col(vec)))
    levels = 1 << (bits - 1)
    if bits == 1:
        coded = V.bits_of(F.col("_r"), strict=True)
        length = D.fold(F.transform("_r", F.abs))
    else:
        top = F.array_max(F.transform("_r", F.abs))
        size = F.transform("_r", lambda x: F.when(top == 0, F.lit(0)).otherwise(F.least(F.floor(F.abs(x) / top * levels), F.lit(levels - 1))).cast("int"))
        coded = F.zip_with(V.bits_of(F.col("_r"), strict=True), size, lambda b, s: F.when(b == 1, s + levels).otherwise(levels - 1 - s).cast("int"))
        length = D.fold(F.zip_with(F.col("_r"), coded, lambda x, c: x * (c + 0.5 - levels) * 2))
    s = F.sqrt("or_c")
    # multiplier = |r| / <r / |r|, code> * sqrt(d), so that code * multiplier / sqrt(d) estimates the residual
    work = work.withColumn("bits", coded).withColumn("multiplier", F.when(F.col("or_c") == 0, F.lit(0.0)).otherwise(s / (length / s / F.sqrt(d))))
    return work.drop("_r")


def estimate(bits: Column, or_c: Column, multiplier: Column, residual: Column, levels: int = 1) -> Column:
    """Estimated squared distance of a query to a coded row; ``residual`` is the query minus the centre."""
    code = F.transform(bits, lambda b: (b + 0.5 - levels) * 2)
    dot = D.fold(F.zip_with(code, residual, lambda b, x: b * x)) / F.sqrt(F.size(residual).cast("double"))
    return or_c + D.norm_squared(residual) - F.lit(2.0) * multiplier * dot


def _estimated(q: np.ndarray, row: np.ndarray, arg: float | None) -> np.ndarray:
    """:func:`estimate` of queries (residual, its squared norm, 0) and rows (code, ``or_c``, ``multiplier``)."""
    dot = K.inner_product(q[:-2], row[:-2], arg) / np.sqrt(len(q) - 2.0)
    return row[-2] + q[-2] - 2.0 * row[-1] * dot


def _estimate_bound(q: np.ndarray, row: np.ndarray, arg: float | None) -> tuple[np.ndarray, np.ndarray]:
    d = q.shape[1] - 2
    scale = 2.0 * np.abs(row[:, -1]) / np.sqrt(d)
    sizes = row[:, -2] + q[:, -2, None] + scale * (np.abs(q[:, :-2]).sum(axis=1)[:, None] * np.abs(row[:, :-2]).max(axis=1))
    return row[:, -2] + q[:, -2, None] - 2.0 * row[:, -1] / np.sqrt(d) * (q[:, :-2] @ row[:, :-2].T), 8 * (d + 8) * K.EPS * sizes


def knn(queries: DataFrame, coded: DataFrame, k: int, levels: int = 1, digits: int | None = None) -> DataFrame:
    """The k nearest coded rows by :func:`estimate`; ``queries`` are (qid, r), the residuals. Distances may be rounded."""
    code = F.transform("bits", lambda b: (b + 0.5 - levels) * 2)
    rows = materialize(coded.select("id", F.concat(code, F.array("or_c", "multiplier")).alias("vec")), "codes")
    q = queries.select("qid", F.concat("r", F.array(D.norm_squared(F.col("r")), F.lit(0.0))).alias("qvec"))

    def plain(some: DataFrame, base: DataFrame) -> DataFrame:
        none = F.size("vec") != F.size("qvec")  # other lengths have no estimate
        return base.crossJoin(some).select("qid", "id", F.when(none, F.lit(None)).cast("double").alias("dis"))

    slack = 0.0 if digits is None else 1.01 * 10.0**-digits
    found = K.pairs(q, rows, K.Kernel(_estimated, _estimate_bound), plain, k=k, slack=slack)
    found = found if digits is None else found.withColumn("dis", F.round("dis", digits) + F.lit(0.0))
    return top_k(found, k).select("qid", "rank", "id", "dis")


def lower_bound(estimated: Column, row_error: Column, query_error: Column) -> Column:
    return F.greatest(F.lit(0.0), estimated - row_error * query_error)


def decode(bits: Column, multiplier: Column, center: Column, levels: int = 1) -> Column:
    scaled = F.transform(bits, lambda b: (b + 0.5 - levels) * 2 * multiplier / F.sqrt(F.size(bits).cast("double")))
    return V.add(scaled, center)
