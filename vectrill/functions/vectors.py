"""Arithmetic, bit and code functions on vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrill.functions.distances import as_double, fold, zipped


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def add_scaled(a: Column, factor: float, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + F.lit(float(factor)) * y)


def add_scalar(a: Column, value: float) -> Column:
    return F.transform(as_double(a), lambda x: x + F.lit(float(value)))


def argmin(values: Column) -> Column:
    """Position (from 0) of the smallest entry, the first of equals."""
    pairs = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_min(pairs)["i"]


def add_scaled_argmin(a: Column, factor: float, b: Column) -> Column:
    return argmin(add_scaled(a, factor, b))


def k_least(values: Column, k: int, largest: bool = False) -> Column:
    """The k smallest (largest) entries as structs (x, i), in order; equal ones by position."""
    sign = -1.0 if largest else 1.0
    pairs = F.transform(as_double(values), lambda x, i: F.struct((x * sign).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((p["x"] * sign).alias("x"), p["i"].alias("i")))


def dot_row(row: list[float], vec: Column) -> Column:
    """Inner product of a constant row with a vector, folded from the left."""
    return fold(F.zip_with(F.array(*[F.lit(float(x)) for x in row]), as_double(vec), lambda c, x: c * x))


def matrix_times(matrix: list[list[float]], vec: Column, bias: list[float] | None = None) -> Column:
    """``matrix`` times the vector, plus ``bias``."""
    bias = bias or [0.0] * len(matrix)
    return F.array(*[dot_row(row, vec) + F.lit(float(b)) for row, b in zip(matrix, bias, strict=True)])


def bits_of(vec: Column, strict: bool = False) -> Column:
    """1 where a component is >= 0 (with ``strict``: > 0), else 0, as an array of int."""
    return F.transform(as_double(vec), lambda x: (x > 0 if strict else x >= 0).cast("int"))


def pack_words(bits: Column, n: int) -> Column:
    """Bits to 64-bit words, bit i of the input in bit i % 64 of word i div 64."""

    def word(w: int) -> Column:
        part = F.slice(bits, 64 * w + 1, min(64, n - 64 * w))
        shifted = F.transform(part, lambda b, i: F.call_function("shiftleft", b.cast("long"), i))
        return F.aggregate(shifted, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.array(*[word(w) for w in range((n + 63) // 64)])


def unpack_words(words: Column, n: int) -> Column:
    """Inverse of :func:`pack_words`."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", F.element_at(words, (i / 64).cast("int") + 1), i % 64).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def signs_of(bits: Column) -> Column:
    """Bits to a vector of +1 and -1."""
    return F.transform(bits, lambda b: b * 2.0 - 1.0)


def shuffle_bits(bits: Column, order: list[int]) -> Column:
    """Entry i of the result is entry ``order[i]``."""
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.element_at(bits, i + 1))


def pack_codes(codes: Column, widths: list[int]) -> Column:
    """Small integers of fixed or varying widths to one long, the first in the lowest bits; 63 bits at most."""
    if sum(widths) > 63:
        raise ValueError("more than 63 bits do not fit a long")
    starts = [sum(widths[:i]) for i in range(len(widths))]
    shifted = F.zip_with(codes, F.array(*[F.lit(s) for s in starts]), lambda c, s: F.call_function("shiftleft", c.cast("long"), s))
    return F.aggregate(shifted, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def unpack_codes(packed: Column, widths: list[int]) -> Column:
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return F.array(*[F.shiftright(packed, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")).cast("int") for s, w in zip(starts, widths, strict=True)])


def remap(vec: Column, positions: list[int]) -> Column:
    """Output j is component ``positions[j]``; -1 gives 0."""
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.when(p < 0, F.lit(0.0)).otherwise(F.element_at(as_double(vec), F.greatest(p, F.lit(0)) + 1)))
