"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, everything but ``[0-9a-z]`` and non-ASCII separates. The automaton
runs over words instead of characters, as a window of 13 words begins and ends with whole words: its symbols are the
numbers of the benchmark's words, any other word of a text is symbol 0 and leads back to the root. Each text is
scanned once; the windows found are kept as word positions, which map back to character offsets of the original.

The automaton is sent to the executors only up to ``max_words`` words and 16 bytes for each of them. A larger benchmark
is divided into blocks within these bounds, each with its automaton. The texts are then scanned once for each block; only
a row number and what was hit leave a scan, and the counts are of the union.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.llm.batches import bounded
from vectrill.llm.names import fresh, quoted, without
from vectrill.runtime import materialize

WINDOW = 13
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of UTF-8 to bytes: A-Z to lower case, separators to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_BUILT: dict[str, tuple] = {}


def words_of(text: str | bytes | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_NORMAL).split()


def original_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets in the original of each word of :func:`words_of`."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return [m.span() for m in WORD.finditer(lowered)]


class WindowAutomaton:
    """All windows of the items; ``scan`` gives (first word, words, item indexes) of each occurrence."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for index, (_, words) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                owners[tuple(ids[i : i + k])].add(index)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(who))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[int, ...]]]:
        if self.empty or not words:
            return []
        get = self.numbers.get
        return [(end - n + 1, n, who) for end, (n, who) in self.automaton.iter(tuple([get(w, 0) for w in words]))]


def _automaton(token: str, items) -> WindowAutomaton:
    """Built once in a worker; only the last one is kept."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = WindowAutomaton(items)
    return _BUILT[token]


def _blocks(benchmark: DataFrame, item: str, text: str, max_words: int, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of items of at most ``max_words`` words, one at a time on the driver. NULL ids read as ''.

    A longer item is cut into pieces that share ``window - 1`` words, so that each of its windows is in one of them.
    """
    rows = benchmark.select(F.coalesce(quoted(item).cast("string"), F.lit("")).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    block: list[tuple[str, list[bytes]]] = []
    n = n_bytes = 0
    most = max(max_words, window)
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        for start in range(0, max(1, len(words) - window + 1), most - window + 1):
            piece = words[start : start + most]
            size = sum(map(len, piece))
            if block and (n + len(piece) > most or n_bytes + size > 16 * most):
                yield block
                block, n, n_bytes = [], 0, 0
            block.append((row.id, piece))
            n, n_bytes = n + len(piece), n_bytes + size
    yield block


_FOUND = "struct<n:bigint,hit:array<int>,items:array<string>>"
_FOUND_ARROW = pa.struct([("n", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scan(text: Column, sent, token: str) -> Column:
    """The number of words of each text, the words hit and the items found, NULL if none. Runs once for each row."""

    def scan(texts: pa.Array) -> pa.Array:
        machine = _automaton(token, sent.value)
        out = []
        for value in texts.cast(pa.binary()):
            words = words_of(value.as_py())
            found = machine.scan(words)
            at, who = set(), set()
            for first, n, owners in found:
                at.update(range(first, first + n))
                who.update(machine.names[o] for o in owners)
            out.append({"n": len(words), "hit": sorted(at) if found else None, "items": sorted(who) if found else None})
        return pa.array(out, _FOUND_ARROW)

    return F.arrow_udf(scan, _FOUND).asNondeterministic()(text)


def _spans(text: Column, hit: Column) -> Column:
    def place(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, hit in zip(texts, hits, strict=True):
            at = np.array(hit.as_py() or [], np.int64)
            where = original_spans(t.as_py()) if len(at) else []
            cuts = np.flatnonzero(np.diff(at) > 1)
            out.append([{"begin": where[a][0], "end": where[b][1]} for a, b in zip(at[[0, *(cuts + 1)]], at[[*cuts, -1]], strict=True)] if len(at) else [])
        return pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(place, "array<struct<begin:int,end:int>>")(text, hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", max_words: int = 100_000, spans: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and, with ``spans``, hit_spans.

    A text is contaminated if it has hit words and they are at least a twentieth of its words. ``prefix`` goes
    before the names of the added columns; columns of ``docs`` of those names are replaced, others don't matter. NULL
    and empty texts have no words; items without words match nothing; equal items and equal ids count once, and so do
    repeated rows, each for itself; an empty benchmark hits nothing, and an empty table gives an empty result.
    """
    context = bounded(docs.sparkSession).sparkContext
    result, row = fresh(docs.columns, "_found", "_row")
    blocks = _blocks(benchmark, item, item_text, max_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        state = docs.withColumn(result, _scan(quoted(text), context.broadcast(first), uuid.uuid4().hex))
    else:
        keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        hits = []
        for block in itertools.chain([first, second], blocks):
            found = keyed.select(row, _scan(quoted(text), context.broadcast(block), uuid.uuid4().hex).alias(result))
            hits.append(materialize(found.where(F.col(result)["hit"].isNotNull()), "hits"))
        every = hits[0]
        for found in hits[1:]:
            every = every.union(found)
        merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(result)[c])))).alias(c) for c in ("hit", "items")]
        every = every.groupBy(F.col(row).alias("_r")).agg(*merged)
        words = F.coalesce(F.regexp_count(quoted(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        every = every.select("_r", F.struct("hit", "items").alias("_h"))
        state = keyed.join(every, F.col(row) == F.col("_r"), "left").select(*map(quoted, docs.columns), F.struct(words.alias("n"), F.col("_h.hit").alias("hit"), F.col("_h.items").alias("items")).alias(result))
    n, hit, items = (F.col(result)[c] for c in ("n", "hit", "items"))
    n_hit = F.when(hit.isNull(), F.lit(0)).otherwise(F.size(hit)).cast("long")
    out = {
        "n_words": n, "n_hit": n_hit, "n_items": F.when(items.isNull(), F.lit(0)).otherwise(F.size(items)).cast("long"),
        "items_sha256": F.sha2(F.coalesce(F.array_join(F.array_sort(items), ","), F.lit("")).cast("binary"), 256),
        "contaminated": (n_hit > 0) & (n_hit * 20 >= n),
    }
    if spans:
        out["hit_spans"] = _spans(quoted(text), hit)
    kept = without(docs, [prefix + o for o in out])
    return state.select(*map(quoted, kept), *[v.alias(prefix + c) for c, v in out.items()])
