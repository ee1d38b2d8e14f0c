"""Index descriptions as strings, parsed to a plan and run as DataFrame pipelines.

A description names transforms, a coarse quantizer, a code and wrappers, such as ``PCA32,IVF100,SQ8`` or ``HNSW32,Flat``.
``parse`` gives the plan (dataclasses), ``str`` of a plan gives a description again, and ``build`` makes a searchable
index from it. Variants of a description that differ in memory layout only mean the same plan here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators import binary as B
from vectrill.operators import graph as G
from vectrill.operators import ivf as I
from vectrill.operators import search as S
from vectrill.operators import transforms as P
from vectrill.operators.clustering import KMeans
from vectrill.operators.codecs import pq as K
from vectrill.operators.codecs import scalar as Q
from vectrill.operators.codecs.exotic import Lattice
from vectrill.operators.topk import top_k


#: Beyond so many candidates for refinement, it is counted whether the nearest rows are among them, and they aren't made.
WIDE = 1_000


class UnknownDescription(ValueError):
    """No production fits; the message names the part."""


class UnsupportedPlan(NotImplementedError):
    """The description is well-formed, but its plan can't be built here."""


@dataclass(frozen=True)
class Node:
    """A step of a plan: its kind and its arguments, in the order of the description."""

    kind: str
    args: tuple[tuple[str, Any], ...] = ()

    def __getitem__(self, name: str) -> Any:
        return dict(self.args).get(name)


def node(kind: str, **args: Any) -> Node:
    return Node(kind, tuple((k, v) for k, v in args.items() if v is not None and v is not False))


@dataclass(frozen=True)
class Plan:
    code: Node
    transforms: tuple[Node, ...] = ()
    coarse: Node | None = None
    id_map: str | None = None
    refine: Node | Plan | None = None
    row_scale: str | None = None
    binary: bool = False

    def __str__(self) -> str:
        parts = [_show(t) for t in self.transforms]
        if self.row_scale:
            parts.append(self.row_scale)
        if self.coarse:
            parts.append(_show(self.coarse))
        if not (self.binary and self.coarse):
            parts.append(_show(self.code))
        if self.refine is not None:
            parts.append("RFlat" if isinstance(self.refine, Node) and self.refine.kind == "flat" else f"Refine({self.refine if isinstance(self.refine, Plan) else _show(self.refine)})")
        if self.id_map:
            parts.append(self.id_map)
        return ",".join(parts)


def _number(text: str | None, default: int | None = None) -> int | None:
    return int(text) if text else default


_NORMS = "none|float|qint8|qint4|cqint8|cqint4|lsq2x4|rq2x4"
_SQ = r"SQ(?P<sq>4|6|8|fp16|bf16|8_direct_signed|8_direct)"

#: (pattern of a whole part, what it makes). Patterns are tried in order.
_TRANSFORMS = (
    (r"PCA(?P<w>W)?(?P<r>R)?(?P<d>\d+)", lambda m: node("pca", d=int(m["d"]), whiten=bool(m["w"]), rotate=bool(m["r"]))),
    (r"L2[nN]orm", lambda m: node("normalize")),
    (r"RR(?P<d>\d+)?", lambda m: node("rotation", d=_number(m["d"]))),
    (r"ITQ(?P<d>\d+)?", lambda m: node("itq", d=_number(m["d"]))),
    (r"OPQ(?P<m>\d+)(?:_(?P<d>\d+))?", lambda m: node("opq", m=int(m["m"]), d=_number(m["d"]))),
    (r"Pad(?P<d>\d+)", lambda m: node("pad", d=int(m["d"]))),
)
_CODES = (
    (r"Flat", lambda m: node("flat")),
    (r"FlatDedup", lambda m: node("flat", dedup=True)),
    (r"Flat(?:L2)?Panorama(?P<n>\d+)?(?:_(?P<b>\d+))?", lambda m: node("flat", levels=_number(m["n"]), batch=_number(m["b"]), bounds=True)),
    (r"LSH(?P<n>\d+)?(?P<r>r)?(?P<t>t)?", lambda m: node("lsh", bits=_number(m["n"]), rotate=bool(m["r"]), medians=bool(m["t"]))),
    (r"ZnLattice(?P<m>\d+)x(?P<r>\d+)_(?P<b>\d+)", lambda m: node("lattice", m=int(m["m"]), r2=int(m["r"]), bits=int(m["b"]))),
    (_SQ, lambda m: node("sq", type=m["sq"])),
    (r"PQ(?P<a>\d+)\+(?P<b>\d+)", lambda m: node("pq", m=int(m["a"]), refine_m=int(m["b"]), bits=8)),
    (r"PQ(?P<m>\d+)x4fs(?P<r>r)?(?:_(?P<b>\d+))?", lambda m: node("pq", m=int(m["m"]), bits=4, block=_number(m["b"]), residual=bool(m["r"]), fast=True)),
    (r"PQ(?P<m>\d+)(?:x(?P<b>\d+))?(?P<np>np)?", lambda m: node("pq", m=int(m["m"]), bits=_number(m["b"], 8), plain=bool(m["np"]))),
    (r"(?P<k>RQ|LSQ)(?P<m>\d+)x4fs(?P<r>r)?(?:_(?P<b>\d+))?(?:_N(?P<n>" + _NORMS + r"))?", lambda m: node(m["k"].lower(), m=int(m["m"]), bits=4, norm=m["n"], fast=True)),
    (r"(?P<k>PRQ|PLSQ)(?P<s>\d+)x(?P<m>\d+)x4fs(?P<r>r)?(?:_(?P<b>\d+))?(?:_N(?P<n>" + _NORMS + r"))?", lambda m: node(m["k"].lower(), split=int(m["s"]), m=int(m["m"]), bits=4, norm=m["n"], fast=True)),
    (r"(?P<k>RQ|LSQ|RCQ|LSCQ)(?P<m>\d+)x(?P<b>\d+)(?:_N(?P<n>" + _NORMS + r"))?", lambda m: node(m["k"].lower(), m=int(m["m"]), bits=int(m["b"]), norm=m["n"])),
    (r"(?P<k>RQ|RCQ)(?P<v>\d+x\d+(?:_\d+x\d+)+)(?:_N(?P<n>" + _NORMS + r"))?", lambda m: node(m["k"].lower(), steps=m["v"], norm=m["n"])),
    (r"(?P<k>PRQ|PLSQ)(?P<s>\d+)x(?P<m>\d+)x(?P<b>\d+)(?:_N(?P<n>" + _NORMS + r"))?", lambda m: node(m["k"].lower(), split=int(m["s"]), m=int(m["m"]), bits=int(m["b"]), norm=m["n"])),
    (r"RaBitQ(?P<b>[1-9])?", lambda m: node("rabitq", bits=_number(m["b"], 1))),
    (r"RaBitQfs(?P<b>[1-9])?(?:_(?P<x>\d+))?", lambda m: node("rabitq", bits=_number(m["b"], 1), block=_number(m["x"]), fast=True)),
    (r"SH(?P<p>-?[\d.e+-]+)?(?P<t>[gcm])?", lambda m: node("spectral", period=float(m["p"]) if m["p"] else None, thresholds=m["t"])),
)
_COARSE = (
    (r"IVF(?P<n>\d+[kM]?)", lambda m: node("ivf", n=_size(m["n"]))),
    (r"IMI2x(?P<b>\d+)", lambda m: node("imi", m=2, bits=int(m["b"]))),
    (r"IVF(?P<n>\d+[kM]?)_HNSW(?P<m>\d+)?", lambda m: node("ivf", n=_size(m["n"]), graph="hnsw", m=_number(m["m"], 32))),
    (r"IVF(?P<n>\d+[kM]?)_NSG(?P<m>\d+)", lambda m: node("ivf", n=_size(m["n"]), graph="nsg", m=int(m["m"]))),
    (r"IVF(?P<n>\d+[kM]?)\((?P<x>.+)\)", lambda m: node("ivf", n=_size(m["n"]), quantizer=parse(m["x"]))),
    (r"Residual(?P<m>\d+)x(?P<b>\d+)", lambda m: node("residual", m=int(m["m"]), bits=int(m["b"]))),
    (r"Residual(?P<n>\d+[kM]?)", lambda m: node("residual", n=_size(m["n"]))),
)
_GRAPHS = (
    (r"HNSW(?P<m>\d+)?", lambda m: node("hnsw", m=_number(m["m"], 32))),
    (r"NSG(?P<m>\d+)?", lambda m: node("nsg", m=_number(m["m"], 32))),
)
_SVS = re.compile(r"SVS(?:Flat|Vamana.*|IVF.*)")
_GRAPH_CODES = (
    (r"Flat", lambda m: node("flat")),
    (r"FlatPanorama(?P<n>\d+)?(?:_(?P<b>\d+))?", lambda m: node("flat", bounds=True)),
    (r"PQ(?P<m>\d+)(?:x(?P<b>\d+))?(?:np)?", lambda m: node("pq", m=int(m["m"]), bits=_number(m["b"], 8))),
    (_SQ, lambda m: node("sq", type=m["sq"])),
    (r"(?:2x)?(?P<n>\d+)\+PQ(?P<m>\d+)(?:x(?P<b>\d+))?", lambda m: node("two_layer", n=int(m["n"]), m=int(m["m"]), bits=_number(m["b"], 8))),
)
_BINARY = (
    (r"BFlat", lambda m: Plan(node("bflat"), binary=True)),
    (r"BIVF(?P<n>\d+)(?:_HNSW(?P<m>\d+))?", lambda m: Plan(node("bflat"), coarse=node("bivf", n=int(m["n"]), m=_number(m["m"])), binary=True)),
    (r"BHNSW(?P<m>\d+)?", lambda m: Plan(node("bhnsw", m=_number(m["m"], 32)), binary=True)),
    (r"BHash(?P<n>\d+)x(?P<b>\d+)", lambda m: Plan(node("bhash", tables=int(m["n"]), bits=int(m["b"])), binary=True)),
    (r"BHash(?P<b>\d+)", lambda m: Plan(node("bhash", tables=1, bits=int(m["b"])), binary=True)),
)


def _size(text: str) -> int:
    return int(text[:-1]) * (1024 if text[-1] == "k" else 1024 * 1024) if text[-1] in "kM" else int(text)


def _match(rules, part: str):
    for pattern, make in rules:
        m = re.fullmatch(pattern, part)
        if m:
            return make(m)
    return None


def split_parts(text: str) -> list[str]:
    """Parts between commas, those within parentheses left whole."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise UnknownDescription(f"unbalanced parentheses in {text!r}")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    if depth:
        raise UnknownDescription(f"unbalanced parentheses in {text!r}")
    return [p.strip() for p in [*parts, text[start:]]]


def parse(text: str) -> Plan:
    """The plan of a description; :class:`UnknownDescription` names what isn't understood."""
    parts = split_parts(text)
    id_map = None
    for at in (0, -1):
        if parts[at] in ("IDMap", "IDMap2") and len(parts) > 1:
            id_map = parts.pop(at)
            break
    refine: Node | Plan | None = None
    if len(parts) > 1 and parts[-1] == "RFlat":
        parts.pop()
        refine = node("flat")
    elif len(parts) > 1 and (m := re.fullmatch(r"Refine(Panorama)?\((.+)\)", parts[-1])):
        parts.pop()
        refine = parse(m[2])
    if len(parts) == 1 and parts[0].startswith("(") and parts[0].endswith(")"):
        return _with(parse(parts[0][1:-1]), id_map, refine)
    if len(parts) == 1 and (plan := _match(_BINARY, parts[0])) is not None:
        return _with(plan, id_map, refine)
    steps: list[Node] = []
    while len(parts) > 1 and (t := _match(_TRANSFORMS, parts[0])) is not None:
        # a transform right ahead of SH belongs to it all the same: it is applied first
        steps.append(t)
        parts.pop(0)
    row_scale = parts.pop(0) if len(parts) > 1 and parts[0] in ("MinMax", "MinMaxFP16") else None
    if not parts or not parts[0]:
        raise UnknownDescription(f"nothing to index in {text!r}")
    if _SVS.fullmatch(parts[0]):
        # external graph libraries: their plain tables and proximity graphs
        return _with(Plan(node("flat") if parts[0] == "SVSFlat" else node("hnsw", m=32), tuple(steps)), id_map, refine)
    head = parts[0]
    joined = re.fullmatch(r"((?:HNSW|NSG)\d*)_(.+)", head)
    if joined and len(parts) == 1:
        parts = [joined[1], joined[2]]
        head = parts[0]
    graph = _match(_GRAPHS, head)
    if graph is not None:
        code = _match(_GRAPH_CODES, parts[1]) if len(parts) == 2 else node("flat") if len(parts) == 1 else None
        if code is None:
            raise UnknownDescription(f"no graph storage {','.join(parts[1:])!r} in {text!r}")
        return _with(Plan(code, tuple(steps), graph, row_scale=row_scale), id_map, refine)
    coarse = _match(_COARSE, head)
    if coarse is not None:
        rest = parts[1:]
        inner = []
        while len(rest) > 1 and (t := _match(((r"(?:ITQ|PCA|PCAR)(?P<d>\d+)?", lambda m: node("pca" if m[0].startswith("PCA") else "itq", d=_number(m["d"]), rotate=m[0].startswith("PCAR"))),), rest[0])) is not None:
            inner.append(t)
            rest = rest[1:]
        code = _match(_CODES, rest[0]) if len(rest) == 1 else None
        if code is None or code.kind in ("lsh", "lattice"):
            raise UnknownDescription(f"no list code {','.join(rest)!r} in {text!r}")
        return _with(Plan(code, (*steps, *inner), coarse, row_scale=row_scale), id_map, refine)
    code = _match(_CODES, head) if len(parts) == 1 else None
    if code is None or code.kind == "spectral":
        raise UnknownDescription(f"{','.join(parts)!r} in {text!r} is no index")
    return _with(Plan(code, tuple(steps), row_scale=row_scale), id_map, refine)


def _with(plan: Plan, id_map: str | None, refine: Node | Plan | None) -> Plan:
    return Plan(plan.code, plan.transforms, plan.coarse, id_map or plan.id_map, refine if refine is not None else plan.refine, plan.row_scale, plan.binary)


def _show(n: Node) -> str:
    a = n.args and dict(n.args) or {}
    norm = f"_N{a['norm']}" if "norm" in a else ""
    show = {
        "pca": lambda: f"PCA{'W' if a.get('whiten') else ''}{'R' if a.get('rotate') else ''}{a.get('d', '')}", "normalize": lambda: "L2norm", "rotation": lambda: f"RR{a.get('d', '')}",
        "itq": lambda: f"ITQ{a.get('d', '')}", "opq": lambda: f"OPQ{a['m']}" + (f"_{a['d']}" if "d" in a else ""), "pad": lambda: f"Pad{a['d']}",
        "flat": lambda: "FlatDedup" if a.get("dedup") else "Flat", "lsh": lambda: f"LSH{a.get('bits', '')}{'r' if a.get('rotate') else ''}{'t' if a.get('medians') else ''}",
        "lattice": lambda: f"ZnLattice{a['m']}x{a['r2']}_{a['bits']}", "sq": lambda: f"SQ{a['type']}",
        "pq": lambda: f"PQ{a['m']}+{a['refine_m']}" if "refine_m" in a else f"PQ{a['m']}" + (f"x{a['bits']}" if a["bits"] != 8 else ""),
        "rabitq": lambda: f"RaBitQ{a['bits'] if a['bits'] > 1 else ''}", "spectral": lambda: f"SH{a.get('period', '')}{a.get('thresholds', '')}",
        "ivf": lambda: f"IVF{a['n']}" + (f"({a['quantizer']})" if "quantizer" in a else f"_{a['graph'].upper()}{a['m']}" if "graph" in a else ""), "imi": lambda: f"IMI2x{a['bits']}",
        "residual": lambda: f"Residual{a['n']}" if "n" in a else f"Residual{a['m']}x{a['bits']}", "hnsw": lambda: f"HNSW{a['m']}", "nsg": lambda: f"NSG{a['m']}",
        "two_layer": lambda: f"{a['n']}+PQ{a['m']}", "bflat": lambda: "BFlat", "bivf": lambda: f"BIVF{a['n']}" + (f"_HNSW{a['m']}" if "m" in a else ""), "bhnsw": lambda: f"BHNSW{a['m']}",
        "bhash": lambda: f"BHash{a['bits']}" if a["tables"] == 1 else f"BHash{a['tables']}x{a['bits']}",
    }
    if n.kind in show:
        return show[n.kind]()
    return f"{n.kind.upper()}{a['steps']}{norm}" if "steps" in a else f"{n.kind.upper()}{str(a['split']) + 'x' if 'split' in a else ''}{a['m']}x{a['bits']}{norm}"


def code_bytes(plan: Plan, d: int) -> int:
    """Bytes of a row's code, without its id."""
    for t in plan.transforms:
        d = t["d"] or d
    a = plan.code
    if plan.binary:
        return d // 8
    size = {"flat": lambda: 4 * d, "lsh": lambda: ((a["bits"] or d) + 7) // 8, "rabitq": lambda: (a["bits"] * d + 7) // 8 + 8, "spectral": lambda: (d + 7) // 8,
            "sq": lambda: {"4": (d + 1) // 2, "6": (6 * d + 7) // 8, "8": d, "fp16": 2 * d, "bf16": 2 * d}.get(a["type"], d),
            "lattice": lambda: a["m"] * 8, "two_layer": lambda: 4 + a["m"]}.get(a.kind)
    if size:
        return size()
    return ((a["split"] or 1) * (a["m"] or 1) * (a["bits"] or 8) + 7) // 8 + (a["refine_m"] or 0)


def _transform(n: Node, d: int) -> tuple[P.Transform, int]:
    out = n["d"] or d
    if n.kind == "pca":
        return P.PCA(out, power=-0.5 if n["whiten"] else 0.0, rotate=bool(n["rotate"])), out
    if n.kind == "normalize":
        return P.Normalize(), d
    if n.kind == "rotation":
        return P.random_rotation(d, out), out
    if n.kind == "itq":
        return P.ITQ(out), out
    if n.kind == "opq":
        return P.OPQ(n["m"], out, rounds=10), out
    return P.Remap.pad(d, out), out


def _codec(n: Node, d: int):
    bits = n["bits"] or 8
    if n.kind == "flat":
        return None
    if n.kind == "sq":
        kinds = {"fp16": Q.HalfPrecision(), "bf16": Q.HalfPrecision(brain=True), "8_direct": Q.DirectBytes(), "8_direct_signed": Q.DirectBytes(signed=True)}
        return kinds.get(n["type"]) or Q.ScalarQuantizer(int(n["type"]))
    if n["refine_m"]:
        return K.RefinedProduct(K.ProductQuantizer(n["m"], bits), K.ProductQuantizer(n["refine_m"], bits))
    if n.kind in ("pq", "two_layer"):
        return K.ProductQuantizer(n["m"], bits)
    if n.kind in ("rq", "rcq"):
        steps = [tuple(map(int, s.split("x"))) for s in n["steps"].split("_")] if n["steps"] else [(n["m"], bits)]
        if len({b for _, b in steps}) > 1:
            raise UnsupportedPlan("residual stages of different widths")
        return K.ResidualQuantizer(sum(m for m, _ in steps), steps[0][1])
    if n.kind in ("lsq", "lscq"):
        return K.LocalSearchQuantizer(n["m"], bits)
    if n.kind in ("prq", "plsq"):
        make = K.ResidualQuantizer if n.kind == "prq" else K.LocalSearchQuantizer
        return K.SplitCodec([make(n["m"], bits) for _ in range(n["split"])])
    if n.kind == "lattice":
        return Lattice(n["m"], n["r2"], n["bits"])
    if n.kind == "lsh":
        width = n["bits"] or d
        return Q.SignBits(width, P.random_rotation(d, width) if n["rotate"] or width > d else None, bool(n["medians"]))
    if n.kind in ("rabitq", "spectral"):
        return n.kind
    raise UnsupportedPlan(f"no codec for {n.kind}")


@dataclass
class Index:
    """A built plan. ``search`` and ``range_search`` take queries (qid, qvec) in the original space.

    Of a scan of codes, the ``k * k_factor`` best are refined; with an infinite factor all rows are, in whatever order
    their codes put them.
    """

    plan: Plan
    which: str = "l2"
    chain: P.Chain = field(default_factory=lambda: P.Chain([]))
    rows: DataFrame | None = None
    originals: DataFrame | None = None
    inverted: I.Inverted | None = None
    centroids: DataFrame | None = None
    codec: Any = None
    center: list[float] | None = None

    def _queries(self, queries: DataFrame) -> DataFrame:
        return self.chain.apply(queries, "qvec")

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, k_factor: float = 1.0, ef: int = 64, selector=None, flips: int = 0) -> DataFrame:
        if self.plan.row_scale:
            raise UnsupportedPlan("a row-wise scaled table is a codec; decode it to search")
        chosen = (lambda df: df) if selector is None else selector.apply
        if self.plan.refine is not None and k_factor == np.inf and self._scans_codes():
            return S.knn(queries, chosen(self.originals), k, self.which)
        wide = k if self.plan.refine is None else max(k, int(np.ceil(k * k_factor)))
        if wide > max(k, WIDE) and self._scans_codes():
            return I.knn_refined(queries, self._queries(queries), chosen(self.rows), chosen(self.originals), k, wide, self.which)
        found = self._search(queries, wide, nprobe, ef, selector, flips)
        return found if self.plan.refine is None else I.refine(found, queries, self.originals, k, self.which)

    def _scans_codes(self) -> bool:
        """Whether a search measures what all rows' codes decode to."""
        plan = self.plan
        return not plan.binary and plan.code.kind != "lsh" and plan.coarse is None and S.kernel_of(D.metric(self.which)) is not None

    def _search(self, queries: DataFrame, k: int, nprobe: int, ef: int, selector, flips: int) -> DataFrame:
        plan, rows = self.plan, self.rows
        if plan.binary:
            if plan.coarse is not None:
                return B.ivf_knn(queries, rows if selector is None else selector.apply(rows), self.centroids, k, nprobe)
            rows = rows if selector is None else selector.apply(rows)
            if plan.code.kind == "bhash":
                return B.hash_knn(queries, rows, k, plan.code["bits"], flips, plan.code["tables"])
            return B.knn(queries, rows, k)  # a graph over codes is an approximation of this
        q = self._queries(queries)
        if plan.code.kind == "lsh":
            coded = self.codec.encode(q, "qvec", "code").drop("qvec").withColumnRenamed("code", "qvec")
            return B.knn(coded, rows if selector is None else selector.apply(rows), k)
        if isinstance(self.codec, _Spectral):
            return top_k(self.codec.scan(self.inverted, q, nprobe, selector), k).select("qid", "rank", "id", "dis")
        if self.inverted is not None:
            return self.inverted.search(q, k, nprobe, selector=selector).select("qid", "rank", "id", "dis")
        if plan.coarse is not None and plan.coarse.kind in ("hnsw", "nsg"):
            return G.graph_knn(q, rows if selector is None else selector.apply(rows), k, ef, plan.coarse.kind, plan.coarse["m"], which=self.which)
        return S.knn(q, rows, k, self.which, selector=selector)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, selector=None, ef: int = 64) -> DataFrame:
        if self.plan.row_scale:
            raise UnsupportedPlan("a row-wise scaled table is a codec; decode it to search")
        rows = self.rows if selector is None else selector.apply(self.rows)
        if self.plan.binary:
            return B.range_join(queries, rows, int(radius))
        found = self._range(queries, rows, radius, nprobe, selector, ef)
        return found if self.plan.refine is None else I.refine_range(found, queries, self.originals, self.which)

    def _range(self, queries: DataFrame, rows: DataFrame, radius: float, nprobe: int, selector, ef: int) -> DataFrame:
        q, coarse = self._queries(queries), self.plan.coarse
        if coarse is not None and coarse.kind in ("hnsw", "nsg"):
            return G.graph_range(q, rows, radius, ef, coarse.kind, coarse["m"], which=self.which)
        if self.plan.code.kind == "lsh":
            return B.range_join(self.codec.encode(q, "qvec", "code").drop("qvec").withColumnRenamed("code", "qvec"), rows, int(radius))
        if isinstance(self.codec, _Spectral):
            return self.codec.scan(self.inverted, q, nprobe, selector).where(F.col("dis") < radius).select("qid", "id", "dis")
        if self.inverted is not None:
            return self.inverted.range_search(q, radius, nprobe, selector=selector).select("qid", "id", "dis")
        return S.range_join(q, self.rows, radius, self.which, selector=selector)


def _refuse(plan: Plan) -> None:
    """Raise for what a description asks for and no operator here does, instead of building something else."""
    code, coarse = plan.code, plan.coarse
    asked = {
        "norms stored apart": code["norm"] is not None, "storage without repeated vectors": bool(code["dedup"]), "a two-layer code under a graph": code.kind == "two_layer",
        "row bounds of half precision": plan.row_scale == "MinMaxFP16", "another quantizer for lists": coarse is not None and (coarse["quantizer"] is not None or coarse.kind == "ivf" and coarse["graph"] is not None),
        "refinement by another plan than a code": isinstance(plan.refine, Plan) and (plan.refine.coarse is not None or bool(plan.refine.transforms) or plan.refine.binary or plan.refine.code.kind in ("lsh", "rabitq", "spectral", "two_layer")),
    }
    for what, there in asked.items():
        if there:
            raise UnsupportedPlan(what)


def build(text: str | Plan, base: DataFrame, which: str = "l2", train: DataFrame | None = None, rounds: int = 10) -> Index:
    """Train on ``train`` (or the rows) and index ``base`` (id, vec); binary plans take packed words as ``vec``."""
    plan = parse(text) if isinstance(text, str) else text
    _refuse(plan)
    if plan.code.kind == "spectral" and which != "l2":
        raise UnsupportedPlan("spectral hashes are for l2 only")
    if plan.coarse is not None and plan.coarse.kind in ("hnsw", "nsg") and which not in G.METRICS:
        raise UnsupportedPlan(f"no graph search by {which}")
    train = base if train is None else train
    if plan.binary:
        index = Index(plan, "hamming", rows=base, originals=base)
        if plan.coarse is not None:
            words = len(base.select("vec").first()[0])
            index.centroids = B.train_centroids(train, 64 * words, plan.coarse["n"], rounds)
            index.rows = B.assign(base, index.centroids)
        return index
    d = len(base.select("vec").first()[0])
    steps, at = [], d
    for n in plan.transforms:
        step, at = _transform(n, at)
        steps.append(step)
    chain = P.Chain(steps).fit(train)
    rows, sample = chain.apply(base), chain.apply(train)
    index = Index(plan, which, chain, rows, base)
    if isinstance(plan.refine, Plan) and (finer := _codec(plan.refine.code, d)) is not None:
        finer.fit(train)
        index.originals = finer.decode(finer.encode(base)).drop("code")
    similarity = D.metric(which).similarity
    codec = index.codec = _codec(plan.code, at)
    if plan.row_scale:
        index.codec = Q.RowMinMax() if codec is None or not isinstance(codec, Q.ScalarQuantizer) else Q.RowMinMax(Q.ScalarQuantizer(codec.bits, True, low=[0.0], width=[1.0]))
        index.rows = index.codec.encode(rows)
        return index
    if plan.code.kind == "lsh":
        codec.fit(sample)
        index.rows = codec.encode(rows).drop("vec").withColumnRenamed("code", "vec")
        return index
    if plan.coarse is not None and plan.coarse.kind in ("ivf", "imi", "residual"):
        centroids = _coarse_centroids(plan.coarse, sample, rounds, similarity)
        residual = plan.code.kind in ("pq", "rq", "lsq", "prq", "plsq", "rabitq")
        index.inverted = I.Inverted.build(rows, centroids, which, residual)
        lists = index.inverted.lists
        if isinstance(codec, str):
            if codec == "spectral":
                index.codec = _Spectral.fit(plan.code, index.inverted, I.Inverted.build(sample, centroids, which).lists, at)
            index.inverted.lists = index.codec.encode(lists, "vec") if codec == "spectral" else _rabitq_lists(lists, plan.code["bits"])
        elif codec is not None:
            codec.fit(I.Inverted.build(sample, centroids, which, residual).lists)
            index.inverted.lists = codec.decode(codec.encode(lists)).drop("code")
        index.rows = index.inverted.lists
        return index
    if isinstance(codec, str):
        index.rows = _rabitq_lists(_centered(rows, sample, index), plan.code["bits"])
        center = F.array(*[F.lit(c) for c in index.center])
        index.rows = index.rows.withColumn("vec", V.add(F.col("vec"), center))
    elif codec is not None:
        codec.fit(sample)
        index.rows = codec.decode(codec.encode(rows)).drop("code")
    return index


def _centered(rows: DataFrame, sample: DataFrame, index: Index) -> DataFrame:
    center = P.Center().fit(sample)
    index.center = center.mean
    return center.apply(rows)


def _rabitq_lists(lists: DataFrame, bits: int) -> DataFrame:
    """Residuals as what their codes of ``bits`` bits a component decode to."""
    from vectrill.operators.codecs import rabitq

    zero = F.transform("vec", lambda x: F.lit(0.0))
    coded = rabitq.encode(lists, zero, bits=bits)
    return coded.withColumn("vec", rabitq.decode(F.col("bits"), F.col("multiplier"), zero, 1 << (bits - 1))).drop("bits", "or_c", "ip_oc", "multiplier")


@dataclass
class _Spectral:
    """Spectral hashes within lists: components against their list's thresholds (list_no, threshold)."""

    thresholds: DataFrame
    coder: Q.SpectralBits
    d: int

    @classmethod
    def fit(cls, n: Node, inverted: I.Inverted, sample: DataFrame, d: int) -> _Spectral:
        lists = inverted.centroids
        kind = n["thresholds"] or "g"
        if kind == "c":
            thresholds = lists.select("list_no", F.col("centroid").alias("threshold"))
        else:
            thresholds = lists.select("list_no", F.transform("centroid", lambda x: F.lit(0.0)).alias("threshold"))
        if kind == "m":
            parts = sample.select("list_no", F.posexplode(D.as_double(F.col("vec"))).alias("at", "x")).groupBy("list_no", "at").agg(F.expr("percentile(x, 0.5)").alias("x"))
            medians = parts.groupBy("list_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("_m"))
            thresholds = thresholds.join(medians, "list_no", "left").select("list_no", F.coalesce("_m", "threshold").alias("threshold"))
        return cls(thresholds, Q.SpectralBits(-1e10 if n["period"] is None else n["period"]), d)

    def encode(self, rows: DataFrame, vec: str) -> DataFrame:
        """``rows`` (list_no, ...) with packed codes for vectors."""
        coded = rows.join(F.broadcast(self.thresholds), "list_no")
        return coded.withColumn(vec, V.pack_words(self.coder.bits(D.as_double(F.col(vec)), F.col("threshold")), self.d)).drop("threshold")

    def scan(self, inverted: I.Inverted, queries: DataFrame, nprobe: int, selector) -> DataFrame:
        """(qid, id, list_no, dis) by Hamming distance; a query has a code for each list."""
        return inverted.scan(self.encode(inverted.probe(queries, nprobe), "qvec"), D.hamming, selector)


def _coarse_centroids(n: Node, sample: DataFrame, rounds: int, similarity: bool) -> np.ndarray:
    if n.kind == "ivf":
        return KMeans(n["n"], rounds, spherical=similarity, similarity=similarity).fit(sample).centroids
    if n.kind == "residual" and n["n"]:
        return KMeans(n["n"], rounds).fit(sample).centroids
    x = P.sample_matrix(sample)
    if n.kind == "imi":
        cells = 1 << (n["bits"] * n["m"])
        books = K.train_numpy(x, n["m"], n["bits"])
        codes = np.stack(np.meshgrid(*[np.arange(len(b)) for b in books], indexing="ij"), axis=-1).reshape(-1, n["m"])
        if cells > 1 << 16:
            raise UnsupportedPlan("more than 65536 cells of a multi-index aren't enumerated; use multi_index_probe")
        return K.decode_numpy(codes, books)
    rq = K.ResidualQuantizer(n["m"], n["bits"], beam=1)
    rq.fit(sample)
    codes = np.stack(np.meshgrid(*[np.arange(len(b)) for b in rq.books], indexing="ij"), axis=-1).reshape(-1, n["m"])
    if len(codes) > 1 << 16:
        raise UnsupportedPlan("more than 65536 virtual centroids")
    return rq.decode_numpy(codes)
