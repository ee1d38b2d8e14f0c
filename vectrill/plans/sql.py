"""Building blocks of the equivalent SQL, with the same order of floating-point operations as the expressions."""

from __future__ import annotations


def fold(values: str) -> str:
    return f"list_reduce(list_prepend(0.0::double, {values}), lambda s, x: s + x)"


def zipped(a: str, b: str, f: str) -> str:
    """``f`` with {x} and {y} for the components as doubles."""
    return f"list_transform(list_zip({a}, {b}), lambda z: {f.format(x='z[1]::double', y='z[2]::double')})"


def ratio(x: str, y: str) -> str:
    return f"(case when ({y}) = 0 then 'nan'::double else ({x}) / ({y}) end)"


def l2(a: str, b: str) -> str:
    return fold(zipped(a, b, "({x} - {y}) * ({x} - {y})"))


def ip(a: str, b: str) -> str:
    return fold(zipped(a, b, "{x} * {y}"))


def norm2(a: str) -> str:
    return fold(f"list_transform({a}, lambda v: v::double * v::double)")


def normalized(a: str) -> str:
    return f"(case when sqrt({norm2(a)}) > 0 then list_transform({a}, lambda v: v::double / sqrt({norm2(a)})) else {a}::double[] end)"


def l1(a: str, b: str) -> str:
    return fold(zipped(a, b, "abs({x} - {y})"))


def top(pairs: str, k: int, by: str = "dis", descending: bool = False, query: str = "qid", extra: str = "") -> str:
    """Top-k of a sub-query with (qid, id, dis)."""
    order = f"{by} desc" if descending else by
    return f"select {query}, rank::int as rank, id, dis{extra} from (select *, row_number() over (partition by {query} order by {order}, id) as rank from ({pairs})) where rank <= {k}"


def cross(dis: str, where: str = "true", q: str = "q.vec_id % 20 = 0") -> str:
    """(qid, id, dis) of every twentieth vector against all; ``dis`` is over q.embedding and e.embedding."""
    return f"select q.vec_id as qid, e.vec_id as id, {dis} as dis from embeddings q, embeddings e where {q} and {where}"
