"""Distance functions as Column expressions.

All of them cast components to double and fold from left to right, so that a result doesn't depend on the plan.
Arrays of different length, and NULL vectors, give NULL. Zero denominators give NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(as_double(a), as_double(b), f)


def ratio(x: Column, y: Column) -> Column:
    return F.when(y == 0, nan()).otherwise(x / y)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return fold(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return fold(zipped(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the normalised vectors; a zero vector stays as it is."""
    return inner_product(normalized(a), normalized(b))


def l1(a: Column, b: Column) -> Column:
    return fold(zipped(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(zipped(a, b, lambda x, y: F.abs(x - y)))


def lp(a: Column, b: Column, p: float) -> Column:
    """Sum of |x - y| ** p, without the root."""
    return fold(zipped(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def canberra(a: Column, b: Column) -> Column:
    return fold(zipped(a, b, lambda x, y: ratio(F.abs(x - y), F.abs(x) + F.abs(y))))


def bray_curtis(a: Column, b: Column) -> Column:
    return ratio(l1(a, b), fold(zipped(a, b, lambda x, y: F.abs(x + y))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """For positive components."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) * 0.5
        return -x * F.ln(m / x) - y * F.ln(m / y)

    return fold(zipped(a, b, term)) * 0.5


def jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima: a similarity."""
    return ratio(fold(zipped(a, b, lambda x, y: F.least(x, y))), fold(zipped(a, b, lambda x, y: F.greatest(x, y))))


def nan_euclidean(a: Column, b: Column) -> Column:
    """Squared differences of the components present in both, scaled up to all; NaN if none is."""
    terms = F.filter(zipped(a, b, lambda x, y: (x - y) * (x - y)), lambda t: ~F.isnan(t))
    n = F.size(terms)
    return F.when(n == 0, nan()).otherwise(F.size(a).cast("double") / n * fold(terms))


def gower(a: Column, b: Column) -> Column:
    """Mean over components: |x - y| of numbers in [0, 1], inequality of categories (negative numbers).

    Components that are NaN on either side are left out; a number over 1, or a number against a category, is NaN.
    """

    def term(x: Column, y: Column) -> Column:
        missing = F.isnan(x) | F.isnan(y)
        numbers = F.when((x > 1) | (y > 1), nan()).otherwise(F.abs(x - y))
        both = F.when((x >= 0) & (y >= 0), numbers).when((x < 0) & (y < 0), (x != y).cast("double")).otherwise(nan())
        return F.when(missing, F.lit(None)).otherwise(both)

    terms = F.filter(zipped(a, b, term), lambda t: t.isNotNull())
    return F.when(F.size(terms) == 0, nan()).otherwise(fold(terms) / F.size(terms))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of packed codes, arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_bytes(a: Column, b: Column) -> Column:
    """Differing entries of codes, arrays of small integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def norm_squared(a: Column) -> Column:
    return fold(F.transform(as_double(a), lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(norm_squared(a))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def l2_from_product(norm_a: Column, norm_b: Column, product: Column) -> Column:
    """Squared distance from squared norms and the inner product."""
    return norm_a + norm_b - 2 * product


@dataclass(frozen=True)
class Metric:
    """A distance (smaller is nearer) or a similarity (larger is nearer)."""

    name: str
    expression: Callable[..., Column]
    similarity: bool = False

    def __call__(self, a: Column, b: Column, arg: float | None = None) -> Column:
        return self.expression(a, b) if arg is None else self.expression(a, b, arg)


METRICS: dict[str, Metric] = {}


def register_metric(name: str, expression: Callable[..., Column], similarity: bool = False) -> Metric:
    """Add a metric of one's own; it can then be named wherever a metric is asked for."""
    METRICS[name] = Metric(name, expression, similarity)
    return METRICS[name]


for _name, _expression, _similarity in (
    ("l2", l2, False), ("ip", inner_product, True), ("cosine", cosine, True), ("l1", l1, False), ("linf", linf, False), ("lp", lp, False),
    ("canberra", canberra, False), ("braycurtis", bray_curtis, False), ("jensenshannon", jensen_shannon, False), ("jaccard", jaccard, True),
    ("nan_euclidean", nan_euclidean, False), ("gower", gower, False), ("hamming", hamming, False), ("hamming_bytes", hamming_bytes, False),
):
    register_metric(_name, _expression, _similarity)


def metric(which: str | Metric) -> Metric:
    if isinstance(which, Metric):
        return which
    try:
        return METRICS[which]
    except KeyError:
        raise ValueError(f"no metric {which!r}; there are {', '.join(sorted(METRICS))}") from None
