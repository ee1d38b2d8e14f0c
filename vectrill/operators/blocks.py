"""Pairs of queries and rows by blocks: NumPy kernels for the metrics, the same numbers as their expressions give.

Queries are sent to all tasks, rows come in Arrow batches. A kernel goes through the dimensions one by one over a block
of pairs, so that sums are folded from the left as in ``functions/distances.py``. Where a bound is cheaper, as one from
matrix products, pairs that it rules out are skipped, and only what is left is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries are sent to the tasks up to so many rows; more of them are handled in several passes over the rows.
QUERY_BLOCK = 20_000
#: Queries and rows of a block that are bounded at a time, and queries of a strip that is measured at a time.
QUERIES, ROWS, STRIP = 256, 2048, 32
#: Beyond this share of a block's pairs, all of them are measured instead of those that are left.
DENSE = 0.15
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Kernel:
    """``exact`` takes (d, ...) arrays of queries and rows that are broadcast against each other.

    ``bound`` takes (n, d) queries and (m, d) rows and gives approximate values and how far they may be off.
    ``prepare`` is applied to either side first. ``regular`` says which vectors it is for, beyond those without NULL.
    """

    exact: Callable[..., np.ndarray]
    bound: Callable[..., tuple[np.ndarray, np.ndarray | float]] | None = None
    prepare: Callable[[np.ndarray], np.ndarray] | None = None
    similarity: bool = False
    regular: Callable[[Column], Column] | None = None


def folded(x: np.ndarray, y: np.ndarray, *terms: Callable) -> list[np.ndarray]:
    """A sum over the first axis for each of the terms, which write to their third argument."""
    shape = np.broadcast_shapes(x.shape[1:], y.shape[1:])
    sums, t, u = [np.zeros(shape) for _ in terms], np.empty(shape), np.empty(shape)
    for a, b in zip(x, y, strict=True):
        for s, term in zip(sums, terms, strict=True):
            term(a, b, t, u)
            np.add(s, t, out=s)
    return sums


def _apart(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
    np.subtract(a, b, out=t)
    np.abs(t, out=t)


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(y == 0, np.nan, x / y)


def _together(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
    np.add(a, b, out=t)
    np.abs(t, out=t)


def bray_curtis(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    return _ratio(*folded(x, y, _apart, _together))


def _product(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
    np.multiply(a, b, out=t)


def _square(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
    np.subtract(a, b, out=t)
    np.multiply(t, t, out=t)


def _share(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
    _apart(a, b, t, u)
    np.add(np.abs(a), np.abs(b), out=u)
    np.divide(t, u, out=t)  # 0 / 0 is NaN, as it should be


def l2(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    return folded(x, y, _square)[0]


def inner_product(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    return folded(x, y, _product)[0]


def l1(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    return folded(x, y, _apart)[0]


def canberra(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    return folded(x, y, _share)[0]


def jaccard(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    # NaN counts as the largest number
    return _ratio(*folded(x, y, lambda a, b, t, u: np.fmin(a, b, out=t), lambda a, b, t, u: np.maximum(a, b, out=t)))


def lp(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    def term(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
        _apart(a, b, t, u)
        np.power(t, p, out=t)

    return folded(x, y, term)[0]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _room(d: int) -> float:
    """What sums over ``d`` terms may be off by, relative to the sum of their sizes; ample."""
    return 8 * (d + 8) * EPS


def _off(x: np.ndarray, y: np.ndarray) -> float:
    """What a matrix product of the block may be off by. Where it may overflow, nothing is known; NaN speaks for itself."""
    most = np.fmax.reduce(_norms(x), initial=0.0) + np.fmax.reduce(_norms(y), initial=0.0)
    return _room(x.shape[1]) * most if most < 1e300 else np.inf


def l2_bound(x: np.ndarray, y: np.ndarray, arg: float | None) -> tuple[np.ndarray, float]:
    """|x|^2 - 2 xy + |y|^2 as a single product."""
    left = np.column_stack([-2 * x, _norms(x), np.ones(len(x))])
    return left @ np.column_stack([y, np.ones(len(y)), _norms(y)]).T, _off(x, y)


def ip_bound(x: np.ndarray, y: np.ndarray, arg: float | None) -> tuple[np.ndarray, float]:
    return x @ y.T, _off(x, y)


#: Steps that a dimension is cut into for rough sums of absolute differences, and dimensions whose steps fit 16 bits.
STEPS, FIT = 1023, 64


def l1_bound(x: np.ndarray, y: np.ndarray, arg: float | None) -> tuple[np.ndarray, float]:
    """From components rounded to steps of the block's widest range: whole numbers of 16 bits, which are faster to sum up."""
    low, high = np.minimum(x.min(axis=0), y.min(axis=0)), np.maximum(x.max(axis=0), y.max(axis=0))
    d, step = x.shape[1], (high - low).max() / STEPS
    if not (np.isfinite(low).all() and np.isfinite(high).all() and 1e-290 < step < 1e290):
        return exact_matrix(Kernel(l1), x, y, None), 0.0
    a, b = (np.ascontiguousarray(np.rint((v - low) / step).astype(np.int16).T) for v in (x, y))
    total, wide = np.zeros((len(x), len(y)), np.int32), 2 * STRIP
    t = np.empty((wide, len(y)), np.int16)
    for at in range(0, len(x), wide):
        rows = total[at : at + wide]
        u = t[: len(rows)]
        for first in range(0, d, FIT):
            sums = np.zeros(u.shape, np.int16)  # wraps, and is read without a sign
            for i in range(first, min(first + FIT, d)):
                np.subtract(a[i, at : at + wide, None], b[i], out=u)
                np.abs(u, out=u)
                np.add(sums, u, out=sums)
            rows += sums.view(np.uint16)
    # half a step for either component, and what sums are rounded by
    return total * step, 1.001 * d * step + _room(d) * 2 * d * max(np.abs(low).max(), np.abs(high).max())


def lp_bound(x: np.ndarray, y: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    def cube(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
        _apart(a, b, t, u)
        np.multiply(t, t, out=u)
        np.multiply(t, u, out=t)

    rough = exact_matrix(Kernel(lambda a, b, _: folded(a, b, cube)[0]) if p == 3 else Kernel(lp), x, y, p)
    return rough, _room(x.shape[1]) * rough


def normalized(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, rounded as the expression does it; zero rows stay."""
    n = np.sqrt(inner_product(x.T, x.T, None))[:, None]
    with np.errstate(all="ignore"):
        return np.where(n > 0, x / n, x) if not np.isnan(n).any() else np.where((n > 0) | np.isnan(n), x / n, x)  # NaN is the largest


def jensen_shannon(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    def term(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
        m = (a + b) * 0.5
        np.subtract(-a * np.log(m / a), b * np.log(m / b), out=t)

    return folded(x, y, term)[0] * 0.5


def js_bound(x: np.ndarray, y: np.ndarray, arg: float | None) -> tuple[np.ndarray, np.ndarray]:
    """From x ln x + y ln y - (x + y) ln ((x + y) / 2): a logarithm for each pair instead of two."""
    own = [(v * np.log(v)).sum(axis=1) for v in (x, y)]
    sizes = [(np.abs(v * np.log(v)) + v).sum(axis=1) for v in (x, y)]

    def mean(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
        np.add(a, b, out=t)
        np.log(t, out=u)
        np.multiply(t, u, out=t)

    both = exact_matrix(Kernel(lambda a, b, _: folded(a, b, mean)[0]), x * 0.5, y * 0.5, None)  # of halves: m ln m
    return 0.5 * (own[0][:, None] + own[1] - 2 * both), 8 * _room(x.shape[1]) * (sizes[0][:, None] + sizes[1])


def _positive(vec: Column) -> Column:
    return F.forall(vec, lambda v: (v > 0) & ~F.isnan(v.cast("double")))


def nan_euclidean(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    def there(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
        _square(a, b, t, u)
        np.copyto(t, 0.0, where=np.isnan(t))

    def counted(a: np.ndarray, b: np.ndarray, t: np.ndarray, u: np.ndarray) -> None:
        _square(a, b, u, t)
        np.copyto(t, ~np.isnan(u))

    total, n = folded(x, y, there, counted)
    return np.where(n == 0, np.nan, float(len(x)) / n * total)


def nan_bound(x: np.ndarray, y: np.ndarray, arg: float | None) -> tuple[np.ndarray, np.ndarray]:
    (a, p), (b, q) = ((np.where(np.isnan(v), 0.0, v), (~np.isnan(v)).astype(float)) for v in (x, y))
    scale = x.shape[1] / (p @ q.T)
    sizes = (a * a) @ q.T + p @ (b * b).T
    return scale * (sizes - 2 * (a @ b.T)), _room(x.shape[1]) * scale * sizes


def gower(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    shape = np.broadcast_shapes(x.shape[1:], y.shape[1:])
    s, t, missing = np.zeros(shape), np.empty(shape), np.zeros(shape)
    for a, b in zip(x, y, strict=True):
        low, high = min(a.min(), b.min()), max(a.max(), b.max())
        if low >= 0 and high <= 1:  # numbers throughout
            _apart(a, b, t, t)
        elif high < 0:  # categories throughout
            np.copyto(t, a != b)
        else:
            gone = np.isnan(a) | np.isnan(b)
            numbers = np.where((a > 1) | (b > 1), np.nan, np.abs(a - b))
            np.copyto(t, np.where((a >= 0) & (b >= 0), numbers, np.where((a < 0) & (b < 0), a != b, np.nan)))
            t[gone] = 0.0
            missing += gone
        np.add(s, t, out=s)
    n = len(x) - missing
    return np.where(n == 0, np.nan, s / n)


def l2_from_product(x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    return inner_product(x, x, None) + inner_product(y, y, None) - 2 * inner_product(x, y, None)


FROM_PRODUCT = Kernel(l2_from_product)

#: By the metric's name.
KERNELS: dict[str, Kernel] = {
    "braycurtis": Kernel(bray_curtis),
    "canberra": Kernel(canberra),
    "l1": Kernel(l1, l1_bound),
    "l2": Kernel(l2, l2_bound),
    "ip": Kernel(inner_product, ip_bound, similarity=True),
    "jaccard": Kernel(jaccard, similarity=True),
    "lp": Kernel(lp, lp_bound),
    "cosine": Kernel(inner_product, ip_bound, normalized, similarity=True),
    "jensenshannon": Kernel(jensen_shannon, js_bound, regular=_positive),
    "nan_euclidean": Kernel(nan_euclidean, nan_bound),
    "gower": Kernel(gower),
}


def exact_matrix(kernel: Kernel, x: np.ndarray, y: np.ndarray, arg: float | None) -> np.ndarray:
    """(n, m) values of all pairs of (n, d) and (m, d)."""
    out, rows = np.empty((len(x), len(y))), np.ascontiguousarray(y.T)[:, None, :]
    for at in range(0, len(x), STRIP):
        out[at : at + STRIP] = kernel.exact(np.ascontiguousarray(x[at : at + STRIP].T)[:, :, None], rows, arg)
    return out


def _key(values: np.ndarray, similarity: bool) -> np.ndarray:
    """The smaller, the better; NaN is the largest value."""
    return np.where(np.isnan(values), -np.inf, -values) if similarity else values


def _some(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _measured(kernel: Kernel, x: np.ndarray, y: np.ndarray, arg: float | None, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Values of the pairs of the queries ``qi`` and the rows ``ri``."""
    if len(qi) > DENSE * len(x) * len(y):
        return exact_matrix(kernel, x, y, arg)[qi, ri]
    values = np.empty(len(qi))
    for at in range(0, len(qi), 1 << 15):
        s = slice(at, at + (1 << 15))
        values[s] = kernel.exact(np.ascontiguousarray(x[qi[s]].T), np.ascontiguousarray(y[ri[s]].T), arg)
    return values


def _rough(kernel: Kernel, x: np.ndarray, y: np.ndarray, arg: float | None) -> tuple[np.ndarray, np.ndarray | float, np.ndarray | None]:
    """Keys of all pairs, how far they may be off, and the values if these are exact."""
    if kernel.bound is None:
        values = exact_matrix(kernel, x, y, arg)
        return _key(values, kernel.similarity), 0.0, values
    rough, off = kernel.bound(x, y, arg)
    return -rough if kernel.similarity else rough, off, None


def _within(kernel: Kernel, x: np.ndarray, y: np.ndarray, arg: float | None, limit: np.ndarray, k: int | None, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, value) of the pairs whose key isn't beyond the query's limit, nor (but for ``slack``) its k-th best here.

    With k, limits that were open are lowered in place to the k-th best here.
    """
    key, off, values = _rough(kernel, x, y, arg)
    if np.ndim(off):
        key, most, off = key - off, 2 * np.max(off), 0.0
    else:
        most = off
    if k is not None and len(y) > k and not (limit < np.inf).all():
        here = np.partition(key, k - 1, axis=1)[:, k - 1] + most + slack
        np.fmin(limit, here, out=limit)
    qi, ri = _some(~(key > (limit + off)[:, None]))
    return qi, ri, values[qi, ri] if values is not None else _measured(kernel, x, y, arg, qi, ri)


def _counts(kernel: Kernel, x: np.ndarray, y: np.ndarray, arg: float | None, edges: list[np.ndarray], inside: Callable[..., np.ndarray]) -> list[np.ndarray]:
    """How many rows are inside each edge, by query. Pairs that the bound leaves open are measured and given to ``inside``."""
    key, off, values = _rough(kernel, x, y, arg)
    found = []
    for number, edge in enumerate(edges):
        sure = key < edge[:, None] - off
        n = np.count_nonzero(sure, axis=1)
        qi, ri = _some(~(sure | (key > edge[:, None] + off)))
        exact = values[qi, ri] if values is not None else _measured(kernel, x, y, arg, qi, ri)
        found.append(n + np.bincount(qi[inside(number, qi, ri, exact)], minlength=len(x)))
    return found


def _best(q: np.ndarray, key: np.ndarray, ids: np.ndarray, n: int, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are among the k best of their query, or as near as the k-th but for ``slack``; and the k-th keys."""
    order = np.lexsort((ids, key, q))
    q, key = q[order], key[order]
    rank = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
    limit = np.full(n, np.inf)
    last = rank == k - 1
    limit[q[last]] = key[last]
    keep = rank < k
    if slack:
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (key[1:] != key[:-1])
        run = np.arange(len(q)) - np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0))
        keep |= (run < k) & (key <= limit[q] + slack)
    return order[keep], limit


def matrix(column: pa.Array) -> np.ndarray:
    """(n, d) of a column of lists that have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Task:
    """What a task does with its rows: the k best of each query, all within a radius, or all pairs.

    With ``probes`` (list_no -> places of queries), rows meet the queries of their list only; with ``centroids`` as
    well, queries are taken relative to the list's centroid. With ``radii``, rows within each are counted by query
    instead, and with ``ahead`` (keys, ids), those that come before the query's key and id.
    """

    kernel: Kernel
    arg: float | None
    k: int | None = None
    radius: float | None = None
    slack: float = 0.0
    probes: dict[int, np.ndarray] | None = None
    centroids: dict[int, np.ndarray] | None = None
    radii: tuple[float, ...] | None = None
    ahead: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def schema(self) -> str:
        if self.ahead is not None or self.radii is not None:
            return ", ".join(["qid long", *(f"n{i} long" for i in range(1 if self.radii is None else len(self.radii)))])
        return "qid long, id long, dis double" + ("" if self.probes is None else ", list_no int")

    def run(self, qids: np.ndarray, queries: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.ahead is not None or self.radii is not None:
            yield self._counted(qids, queries, batches)
            return
        ready = self.kernel.prepare or (lambda v: v)
        starts = range(0, len(qids), QUERIES)
        kept = {at: [np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)] for at in starts}
        limits = {at: np.full(len(qids[at : at + QUERIES]), np.inf) for at in starts}
        plain = ready(queries) if self.centroids is None else None
        for batch in batches:
            if not len(batch):
                continue
            ids, rows = batch.column(0).to_numpy(), ready(matrix(batch.column(1)))
            lists = np.zeros(len(ids), np.int32) if self.probes is None else batch.column(2).to_numpy()
            places = {g: np.flatnonzero(lists == g) for g in np.unique(lists).tolist()}
            for at in starts:
                parts = [kept[at]] if self.k is not None else []
                for g, own in places.items():
                    mine = np.arange(at, min(at + QUERIES, len(qids))) if self.probes is None else self._probing(g, at)
                    if not len(mine):
                        continue
                    x = plain[mine] if plain is not None else ready(queries[mine] - self.centroids[g])
                    for left in range(0, len(own), ROWS):
                        some = own[left : left + ROWS]
                        limit = limits[at][mine - at]
                        q, r, values = self._pairs(x, rows[some], limit)
                        limits[at][mine - at] = limit
                        if self.k is None:
                            yield self._batch(qids[mine[q]], ids[some[r]], values, np.full(len(q), g, np.int32))
                        else:
                            parts.append([mine[q] - at, values, ids[some[r]], np.full(len(q), g, np.int32)])
                if self.k is not None and len(parts) > 1:
                    q, values, found, of = (np.concatenate(p) for p in zip(*parts, strict=True))
                    keep, limits[at] = _best(q, _key(values, self.kernel.similarity), found, len(limits[at]), self.k, self.slack)
                    kept[at] = [q[keep], values[keep], found[keep], of[keep]]
                    limits[at] = limits[at] + self.slack
        for at in starts:
            q, values, found, of = kept[at]
            if len(q):
                yield self._batch(qids[at + q], found, values, of)

    def _counted(self, qids: np.ndarray, queries: np.ndarray, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        """(qid, n0, ...), a row for each query."""
        ready, similarity = self.kernel.prepare or (lambda v: v), self.kernel.similarity
        plain = ready(queries)
        total = np.zeros((1 if self.radii is None else len(self.radii), len(qids)), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            ids, rows = batch.column(0).to_numpy(), ready(matrix(batch.column(1)))
            for at in range(0, len(qids), QUERIES):
                x, part = plain[at : at + QUERIES], slice(at, at + QUERIES)
                for left in range(0, len(rows), ROWS):
                    own = ids[left : left + ROWS]
                    if self.ahead is not None:
                        keys, last = (v[part] for v in self.ahead)
                        edges, inside = [keys], lambda _, q, r, v: _before(_key(v, similarity), own[r], keys[q], last[q])
                    else:
                        edges = [np.full(len(x), -r if similarity else r) for r in self.radii]
                        inside = lambda i, q, r, v: v > self.radii[i] if similarity else v < self.radii[i]
                    with np.errstate(all="ignore"):
                        total[:, part] += _counts(self.kernel, x, rows[left : left + ROWS], self.arg, edges, inside)
        return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), *(pa.array(n) for n in total)], names=["qid", *(f"n{i}" for i in range(len(total)))])

    def _probing(self, g: int, at: int) -> np.ndarray:
        all_ = self.probes.get(g, np.zeros(0, int))
        return all_[np.searchsorted(all_, at) : np.searchsorted(all_, at + QUERIES)]

    def _pairs(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            if self.k is not None:
                return _within(self.kernel, x, y, self.arg, limit, self.k, self.slack)
            if self.radius is not None:
                edge = -self.radius if self.kernel.similarity else self.radius
                q, r, values = _within(self.kernel, x, y, self.arg, np.full(len(x), edge), None)
                inside = values > self.radius if self.kernel.similarity else values < self.radius
                return q[inside], r[inside], values[inside]
            values = exact_matrix(self.kernel, x, y, self.arg)
            return np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)), values.ravel()

    def _batch(self, qids: np.ndarray, ids: np.ndarray, values: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(qids, pa.int64()), pa.array(ids, pa.int64()), pa.array(values, pa.float64(), from_pandas=False)]
        names = ["qid", "id", "dis"]
        if self.probes is not None:
            columns, names = [*columns, pa.array(lists)], [*names, "list_no"]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _before(key: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray) -> np.ndarray:
    """Whether an entry is ahead of another one; NaN comes last, and equal keys go by the id."""
    gone, other_gone = np.isnan(key), np.isnan(other)
    same = (key == other) | (gone & other_gone)
    return (key < other) | (~gone & other_gone) | (same & (ids < other_ids))


def irregular(vec: Column, d: int, kernel: Kernel) -> Column:
    """Whether a vector is none for the kernels: NULL, of another length than ``d``, or with NULL in it."""
    odd = vec.isNull() | (F.size(vec) != d) | F.exists(vec, lambda x: x.isNull())
    if kernel.regular is not None:
        odd = odd | ~kernel.regular(vec)
    return F.coalesce(odd, F.lit(True))


def pairs(queries: DataFrame, base: DataFrame, kernel: Kernel, plain: Callable[[DataFrame, DataFrame], DataFrame], arg: float | None = None, block: int = QUERY_BLOCK, **task) -> DataFrame:
    """(qid, id, dis) by a :class:`Task`; ``plain`` gives what it would do for vectors that are no case for the kernel.

    ``queries`` (qid, qvec) come to the driver, at most ``block`` of them at a time. Where rows have a ``list_no`` and
    queries the ``lists`` they look into, only rows of those are paired, and the result has ``list_no``, too. Queries
    with an ``edge`` and an ``edge_id`` are given how many rows are ahead of it.
    """
    spark, lists = base.sparkSession, [c for c in ("lists", "edge", "edge_id") if c in queries.columns]
    first = queries.where(F.col("qvec").isNotNull()).select("qvec").first()
    d = 0 if first is None else len(first["qvec"])
    if d == 0:
        return plain(queries, base)
    odd = irregular(F.col("qvec"), d, kernel)
    counts = queries.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
    blocks = max(1, -(-counts["n"] // block))
    usual = queries.where(~odd).select("qid", F.col("qvec").cast("array<double>").alias("qvec"), *lists)
    # vectors of another form: all queries against such rows, and such queries against the others
    strange = base.where(irregular(F.col("vec"), d, kernel))
    rows = base.where(~irregular(F.col("vec"), d, kernel))
    out = plain(F.broadcast(queries) if blocks == 1 else queries, strange)
    if counts["odd"]:
        out = out.unionByName(plain(queries.where(odd), rows))
    spread = spread_out(rows.select("id", "vec", *(["list_no"] if "lists" in lists else [])))
    for b in range(blocks):
        part = usual if blocks == 1 else usual.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        out = out.unionByName(_run(spark, part, spread, Task(kernel, arg, **task)))
    return out


def counts(queries: DataFrame, base: DataFrame, kernel: Kernel, plain: Callable[[DataFrame, DataFrame], DataFrame], radii: list[float], arg: float | None = None) -> DataFrame:
    """(qid, n0, n1, ...): how many rows are strictly within each of the radii. ``plain`` gives (qid, id, dis) of all pairs."""
    dis = F.col("dis")

    def tally(q: DataFrame, b: DataFrame) -> DataFrame:
        inside = [((dis > r) if kernel.similarity else (dis < r)) & ~F.isnan(dis) for r in radii]
        return plain(q, b).groupBy("qid").agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(inside)))

    found = pairs(queries, base, kernel, tally, arg, radii=tuple(map(float, radii)))
    return found.groupBy("qid").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(radii))))


def ahead(queries: DataFrame, base: DataFrame, kernel: Kernel, plain: Callable[[DataFrame, DataFrame], DataFrame], arg: float | None = None) -> DataFrame:
    """(qid, n): how many rows rank before the query's ``edge`` (a key: the smaller, the better) and ``edge_id``."""
    key = F.col("dis")
    if kernel.similarity:  # the largest first: NaN, numbers, NULL
        key = F.when(F.isnan("dis"), F.lit(float("-inf"))).otherwise(F.coalesce(-key, F.lit(float("nan"))))

    def tally(q: DataFrame, b: DataFrame) -> DataFrame:
        found = plain(q, b).select("qid", F.struct(key.alias("k"), "id").alias("at")).join(q.select("qid", F.struct(F.col("edge").alias("k"), F.col("edge_id").alias("id")).alias("edge")), "qid")
        return found.groupBy("qid").agg(F.count_if(F.col("at") < F.col("edge")).alias("n0"))

    return pairs(queries, base, kernel, tally, arg).groupBy("qid").agg(F.sum("n0").alias("n"))


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows dealt to two tasks a core: how a small table lies in files says nothing of the work with it."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _run(spark, queries: DataFrame, rows: DataFrame, task: Task) -> DataFrame:
    found = queries.toArrow().combine_chunks()
    vectors = found.column("qvec").combine_chunks()
    qids = found.column("qid").to_numpy()
    if "lists" in queries.columns:
        asked = found.column("lists").combine_chunks()
        place, of = asked.value_parent_indices().to_numpy(), asked.flatten().to_numpy()
        task = replace(task, probes={g: np.unique(place[of == g]) for g in np.unique(of).tolist()})
    if "edge" in queries.columns:
        task = replace(task, ahead=(found.column("edge").to_numpy(), found.column("edge_id").to_numpy()))
    sent = spark.sparkContext.broadcast((qids, matrix(vectors) if len(qids) else np.zeros((0, 1)), task))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, task = sent.value
        return task.run(qids, queries, batches) if len(qids) else iter(())

    return rows.mapInArrow(local, task.schema)
