"""Personal data by patterns and a skip-chain conditional random field.

Strict patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. Looser patterns
give candidates whose surface leaves doubt: numbers of 7 to 19 digits in any grouping, addresses with [at] and [dot],
names that are the local part of an address, four numbers joined by other signs. All of a document's spans are nodes of
one graph. Neighbours in the text are linked, and so are nodes far apart that repeat or resemble each other (the same
digits, the same last seven digits, the same local part): every one with the first strict span of its kind of value, or
else with the first occurrence. Strict spans are observed; loopy belief propagation carries their labels along the links
until the messages settle, and a candidate is added where the probability of its best kind is high enough.

Training is piecewise, from a sample of documents. No labelled data are needed: a strict span is known to be personal,
and so is the same value when it is written without what gives it away (no plus sign, other grouping, [at], one digit
mistyped). These rewritten spans are the positive examples of the node potentials, a multinomial regression, and
candidates that repeat no strict span are the negative ones. As an account or an order can have a number of any shape,
each rewritten span also is a negative example without the words around it: the surface alone decides nothing. Pair
potentials are the counts of label pairs on the links.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm.batches import bounded
from vectrill.llm.textbuf import cut, no_nulls, runs

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns. Where a pattern can only begin at the start of a run of its first characters, or where the last
#: match ended, it is tried nowhere else: otherwise a long run would be read again from each of its characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL, _EMAIL_HERE = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}"), re.compile(rf"{_LOCAL}++{_DOMAIN}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: (form of the value, pattern); forms: 0 an address, 1 four numbers, 2 a number.
_LOOSE = (
    (0, re.compile(rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|[\[(]\x20?(?:at|@)\x20?[\])])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]++)*+", re.I)),
    (1, re.compile(r"(?<![0-9.,-])[0-9]{1,3}(?:[.,-][0-9]{1,3}){3}(?![0-9.,-])")),
    (2, re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])")),
)
_HANDLE = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++")
_WANTED = np.zeros(256, bool)
_WANTED[[*range(0x30, 0x3A), 0x40, 0x28, 0x5B]] = True
#: Lower-case words that announce a kind, fixed.
_CUES = ({"mail", "email", "e-mail", "contact", "write"}, {"ip", "host", "server", "address"}, {"card", "visa", "credit", "account", "iban"}, {"tel", "phone", "call", "fax", "mobile"})
_CUE_LENGTH = 40  # a longer word is no cue
_WORD = re.compile(r"\S++")
_OTHER = re.compile(r"\D+")
N_SURFACE = 16
N_FEATURES = N_SURFACE + len(_CUES)
NONE = len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    while m := (_EMAIL_HERE.match(text, at) if at else None) or EMAIL.search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns' matches that pass their test, in order."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _emails(text)]
    for m in IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _OTHER.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_OTHER.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _plain(value: str) -> str:
    """An address without its disguise."""
    value = re.sub(r"\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?|\x20?@\x20?", "@", value.lower())
    return re.sub(r"\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20?\.\x20?", ".", value)


def value_keys(form: int, value: str) -> tuple[str, str]:
    """What equal values share, and what similar values share; '' for nothing."""
    if form == 0:
        plain = _plain(value)
        local = "@" + plain.split("@")[0]
        return (plain if "@" in plain else "", local)
    if form == 1:
        return "ip" + ".".join(p.lstrip("0") for p in re.split(r"[.,-]", value)), ""
    digits = _OTHER.sub("", value)
    return digits, "t" + digits[-7:] if len(digits) >= 7 else ""


def surface(form: int, value: str) -> list[float]:
    digits = _OTHER.sub("", value)
    n = len(digits)
    seps = set(_OTHER.findall(value))
    return [float(x) for x in (
        1, form == 0, form == 1, form == 2, form == 0 and "@" in value, form == 0 and ("(" in value or "[" in value), form == 0 and "." in _plain(value).split("@")[-1],
        form == 1 and all(map(_octet, re.split(r"[.,-]", value))), form == 2 and n < 9, form == 2 and 9 <= n <= 11, form == 2 and 12 <= n <= 15, form == 2 and n >= 16,
        form == 2 and 12 <= n <= 19 and luhn(digits), form == 2 and not seps, form == 2 and len(seps) > 1, form == 2 and "(" in value)]


class _Words:
    """The words of a text, to look up those in front of a place."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, [], []
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def cues(self, start: int) -> list[float]:
        last = bisect_left(self.ends, start + 1)
        near = []
        for i in range(max(0, last - 2), last):
            a, b = self.starts[i], min(self.ends[i], start)
            if b - a <= _CUE_LENGTH:
                near.append(self.text[a:b].lower().strip(":,.#*$%&!()"))
        if last < len(self.starts) and self.starts[last] < start and start - self.starts[last] <= _CUE_LENGTH:
            near.append(self.text[self.starts[last] : start].lower().strip(":,.#*$%&!()"))
        return [float(any(w in c for w in near)) for c in _CUES]


def rewritten(kind: int, value: str) -> tuple[int, str]:
    """(form, the value as someone might write it who doesn't follow the strict pattern), chosen by its checksum."""
    way, digits = zlib.crc32(value.encode()) >> 4, _OTHER.sub("", value)
    if kind == 0:
        local, domain = value.split("@")
        return 0, (f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain}", f"{local} @ {domain}", local)[way % 4]
    if kind == 1:
        return 1, value.replace(".", "-,"[way % 2])
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + way % 8) % 10)
        return 2, " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)) if way & 8 else wrong
    tail = digits[-10:]
    return 2, (f"({tail[:-7]}) {tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]} {tail[-7:-4]} {tail[-4:]}", tail, f"{tail[-7:-4]}-{tail[-4:]}")[way % 4]


@dataclass
class Graph:
    """Nodes of many documents at once. ``seen`` is a strict span's kind, or -1."""

    doc: list[int] = field(default_factory=list)
    span: list[tuple[int, int]] = field(default_factory=list)
    seen: list[int] = field(default_factory=list)
    features: list[list[float]] = field(default_factory=list)
    keys: list[tuple[str, str]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)  # from, to, 0: neighbours, 1: same, 2: similar

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        taken: list[list[int]] = []  # merged, as spans of different kinds may overlap
        for a, b in sorted((a, b) for a, _, b in base):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        spare = [(m.start(), m.end(), form) for form, pattern in _LOOSE if form or "@" in text or "[" in text or "(" in text for m in pattern.finditer(text)]
        locals_ = {text[a:b].split("@")[0].lower() for a, k, b in base if k == 0}
        if locals_:
            spare += [(m.start(), m.end(), 0) for m in _HANDLE.finditer(text) if m[0].lower().strip(".-") in locals_ and len(m[0]) >= 5]
        # strict spans first, then the longer candidates; what overlaps a kept one goes
        kept = [(a, b, (0, 1, 2, 2)[k], k) for a, k, b in base]
        ends, starts = [b for _, b in taken], [a for a, _ in taken]
        last = 0
        for a, b, form in sorted(set(spare), key=lambda n: (n[0], -n[1], n[2])):
            i = bisect_left(ends, a + 1)
            if a >= last and not (i < len(starts) and starts[i] < b):
                kept.append((a, b, form, -1))
                last = b
        begin, words = len(self.doc), _Words(text) if kept else None
        by_key: dict[tuple[int, str], list[int]] = {}
        for i, (a, b, form, k) in enumerate(sorted(kept), begin):
            value = text[a:b]
            self.doc.append(doc)
            self.span.append((a, b))
            self.seen.append(k)
            self.features.append(surface(form, value) + words.cues(a))
            self.keys.append(value_keys(form, value))
            for level, name in enumerate(self.keys[-1]):
                if name:
                    by_key.setdefault((level, name), []).append(i)
        linked: dict[tuple[int, int], int] = {(i - 1, i): 0 for i in range(begin + 1, len(self.doc))}
        for (level, _), members in sorted(by_key.items(), reverse=True):  # the same values last, as they say most
            anchor = next((i for i in members if self.seen[i] >= 0), members[0])
            linked.update({(min(anchor, i), max(anchor, i)): 1 + level for i in members if i != anchor})
        self.edges += [(a, b, kind) for (a, b), kind in linked.items()]


@dataclass
class SkipChain:
    weights: np.ndarray
    pairs: np.ndarray  # for each type of edge, log potentials of labels; symmetric for skip edges

    def marginals(self, graph: Graph, settled: float = 1e-4, damping: float = 0.3, patience: int = 500) -> np.ndarray:
        """Beliefs of every node by loopy sum-product messages, all documents at once, until no message changes by
        more than ``settled``. Messages that go in circles are damped more and more, and left after ``patience`` rounds."""
        n, k = len(graph.doc), NONE + 1
        unary = np.array(graph.features, float).reshape(n, N_FEATURES) @ self.weights
        seen = np.array(graph.seen, int)
        fixed = seen >= 0
        unary[fixed] = -30
        unary[fixed, seen[fixed]] = 30
        unary -= unary.max(axis=1, keepdims=True)
        if not graph.edges:
            return _normal(unary)
        e = np.array(graph.edges)
        source, to = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        table = np.concatenate([self.pairs[e[:, 2]], self.pairs[e[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        messages = np.zeros((2 * len(e), k))
        for turn in range(patience):
            total = unary.copy()
            np.add.at(total, to, messages)
            out = total[source] - messages[back]
            new = out[:, :, None] + table
            peak = new.max(axis=1, keepdims=True)
            new = (peak + np.log(np.exp(new - peak).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - messages).max()
            keep = max(damping, 1 - 20 / (turn + 1))
            messages = keep * messages + (1 - keep) * new
            if change < settled:
                break
        total = unary
        np.add.at(total, to, messages)
        return _normal(total)


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return x / x.sum(axis=1, keepdims=True) if len(x) else x


def examples(graph: Graph, values: list[str]) -> tuple[Counter, Counter]:
    """Counts of (features, label) of nodes and of (type, label, label) of edges. ``values`` are the strict spans' texts."""
    known = {(d, name): s for d, ks, s in zip(graph.doc, graph.keys, graph.seen, strict=True) if s >= 0 for name in ks if name}
    label = [s if s >= 0 else next((known[d, name] for name in ks if (d, name) in known), NONE) for d, ks, s in zip(graph.doc, graph.keys, graph.seen, strict=True)]
    nodes: Counter = Counter()
    edges: Counter = Counter((t, label[a], label[b]) for a, b, t in graph.edges)
    strict = iter(values)
    for x, s, y in zip(graph.features, graph.seen, label, strict=True):
        if s < 0:
            nodes[tuple(x), y] += 1
            continue
        value = next(strict)
        form, other = rewritten(s, value)
        there = surface(form, other)
        nodes[tuple(there + x[N_SURFACE:]), s] += 1
        nodes[tuple(there + [0.0] * len(_CUES)), NONE] += 1
        for level, (mine, theirs) in enumerate(zip(value_keys((0, 1, 2, 2)[s], value), value_keys(form, other), strict=True)):
            if mine and mine == theirs:
                edges[1 + level, s, s] += 1
                break
    return nodes, edges


def fit(nodes: Counter, edges: Counter, rounds: int = 300, ridge: float = 0.01) -> SkipChain:
    """Piecewise training from counts of (features, label) and of (edge type, label, label)."""
    k = NONE + 1
    w = np.zeros((N_FEATURES, k))
    if nodes:
        rows = sorted(nodes.items())
        features, hot = np.array([x for (x, _), _ in rows]), np.eye(k)[[y for (_, y), _ in rows]]
        each = np.array([n for _, n in rows], float)[:, None]
        each /= each.sum()
        momentum = np.zeros_like(w)
        for _ in range(rounds):
            gradient = features.T @ ((hot - _normal(features @ w)) * each) - ridge * w / k
            momentum = 0.9 * momentum + gradient
            w = w + 0.3 * momentum
    share = np.ones(k)
    for (_, y), n in nodes.items():
        share[y] += n
    share /= share.sum()
    pairs = np.zeros((3, k, k))
    for kind in range(3):
        counts = np.zeros((k, k))
        for (t, a, b), n in edges.items():
            if t == kind:
                counts[a, b] += n
        if kind:
            counts = counts + counts.T
        # how much likelier a label is next to another than by itself, from the labels' shares as one prior pair
        lift = [np.log((c + share) / (c.sum(axis=1, keepdims=True) + 1) / share) for c in (counts, counts.T)]
        pairs[kind] = np.clip((lift[0] + lift[1].T) / 2, -5, 5) * (1.0 if kind else 0.25)
    return SkipChain(w, pairs)


def _graph_of(texts: pa.Array) -> tuple[Graph, list[list[tuple[int, int, int]]]]:
    texts = no_nulls(texts)
    graph, base = Graph(), [[] for _ in range(len(texts))]
    for start, stop in runs(texts):
        for i in np.flatnonzero(cut(texts, start, stop).count_bytes(_WANTED)):
            text = texts[start + int(i)].as_py()
            base[start + int(i)] = base_spans(text)
            graph.add(start + int(i), text, base[start + int(i)])
    return graph, base


def train_from(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 10_000) -> SkipChain:
    """Fit to the spans of at most ``sample`` rows, those of the smallest hash of key and text; repeated rows count once.

    Only counts of the different features and of the pairs of labels reach the driver.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    chosen = rows.select(F.col("h").alias("c")).distinct().orderBy("c").limit(sample)
    rows = rows.join(F.broadcast(chosen), F.col("h") == F.col("c"), "left_semi").dropDuplicates(["h"]).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graph, _ = _graph_of(batch.column(0))
            values = [batch.column(0)[d].as_py()[a:b] for d, (a, b), s in zip(graph.doc, graph.span, graph.seen, strict=True) if s >= 0]
            nodes, edges = examples(graph, values)
            found = [([*x], y, n) for (x, y), n in nodes.items()] + [([float(t), float(a)], b, n) for (t, a, b), n in edges.items()]
            if found:
                x, y, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int64()), pa.array(n, pa.int64())], names=["x", "y", "n"])

    found = rows.mapInArrow(run, "x array<double>, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    nodes = Counter({(tuple(r["x"]), r["y"]): r["n"] for r in found if len(r["x"]) == N_FEATURES})
    edges = Counter({(int(r["x"][0]), int(r["x"][1]), r["y"]): r["n"] for r in found if len(r["x"]) == 2})
    return fit(nodes, edges)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, model: SkipChain, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """One row per document: ``key``, n_email, n_ip, n_card, n_phone and base_sha256 of the strict spans, all spans, n_added.

    NULL and empty texts have no spans. Rows are independent, so that repeated rows get equal results and NULL keys are
    carried like others; of kinds that are equally likely, the first of ``KINDS`` wins. Other columns aren't read.
    """
    bounded(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for offset in range(0, len(whole), 1024):
                batch = whole.slice(offset, 1024)
                graph, base = _graph_of(batch.column(1))
                added: list[list[tuple[int, int, int]]] = [[] for _ in base]
                if graph.doc:
                    p = model.marginals(graph)
                    for i, (doc, (a, b), seen) in enumerate(zip(graph.doc, graph.span, graph.seen, strict=True)):
                        best = int(p[i].argmax())
                        if seen < 0 and best != NONE and p[i, best] >= least:
                            added[doc].append((a, best, b))
                n = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(KINDS))]
                digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                spans = [joined(sorted(b + more)) for b, more in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in n), pa.array(digest), pa.array(spans), pa.array([len(m) for m in added], pa.int64())], names=[f.name for f in schema])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_key", key)
