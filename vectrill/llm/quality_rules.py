"""Quality rules: learned decision lists over document statistics.

Sequential covering: while rejected documents remain uncovered, grow a conjunction of thresholds by information gain
on the growing part of the labelled sample, prune its last conditions on the pruning part, and accept it if it is
precise enough on the pruning part, none of whose rows had a say in growing it; the documents it covers are taken away
and the next rule is learned. A rule that isn't precise enough is given up, and the next begins with another feature or
direction, until none is left. The rules become one ordered Spark conditional expression, so that applying them needs
no Python.

The statistics are computed in Arrow batches from the UTF-8 bytes of whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm.batches import bounded
from vectrill.llm.names import fresh, quoted, without
from vectrill.llm.textbuf import LEAD, cut, no_nulls, runs

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True

#: Long columns, then the ratios that rules may test.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "digit_share", "mark_share", "echo_share")


def _segments(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is not the first of its value, occurs more than once) for each value within its group."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    again = np.zeros(len(v), bool)
    again[order] = same  # lexsort is stable: the first in place order is the first of its run
    more = same.copy()
    more[:-1] |= same[1:]
    many = np.zeros(len(v), bool)
    many[order] = more
    return again, many


def statistics(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS and RATIOS of each text, as arrays."""
    texts = no_nulls(texts)
    found: list[list[np.ndarray]] = []
    for start, stop in runs(texts):
        t = cut(texts, start, stop)
        n, data = stop - start, t.data
        words, owner = t.n_words, t.word_text
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LEAD[data], out=lead[1:])
        chars = _segments(lead[t.ends] - lead[t.starts], t.word_offsets)
        symbols = t.count_bytes(_SYMBOL)

        # windows of 8 words found twice or more: their words are marked by a difference array
        first, window = t.windows(8)
        _, many = _repeats(owner[first], window)
        steps = np.zeros(len(owner) + 9, np.int64)
        np.add.at(steps, first[many], 1)
        np.add.at(steps, first[many] + 8, -1)
        repeated = _segments((np.cumsum(steps)[: len(owner)] > 0).astype(np.int64), t.word_offsets)

        # lines: their bytes' hashes, by the same polynomial as for words, with \n as the only separator
        breaks = np.zeros(256, bool)
        breaks[0x0A] = True
        lines = cut(texts, start, stop, breaks)
        has_word = np.searchsorted(t.starts, lines.ends, "left") > np.searchsorted(t.starts, lines.starts, "left")
        line_owner = lines.word_text[has_word]
        again, _ = _repeats(line_owner, lines.hashes[has_word])
        dup_lines = np.bincount(line_owner[again], minlength=n)
        n_lines = np.bincount(line_owner, minlength=n)

        echo = np.zeros(len(owner), np.int64)
        echo[1:] = (t.hashes[1:] == t.hashes[:-1]) & (owner[1:] == owner[:-1])
        some, w = np.maximum(chars, 1), np.maximum(words, 1)
        found.append([
            words, chars, symbols, dup_lines, repeated,
            symbols / w, repeated / w, dup_lines / np.maximum(n_lines, 1), t.count_bytes(_UPPER) / some, t.count_bytes(_DIGIT) / some,
            t.count_bytes(_MARK) / w, _segments(echo, t.word_offsets) / w])
    kinds = [np.int64] * len(COUNTS) + [np.float64] * len(RATIOS)
    return [np.concatenate([f[i] for f in found]).astype(k) if found else np.zeros(0, k) for i, k in enumerate(kinds)]


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "", drop_text: bool = True) -> DataFrame:
    """``docs`` with COUNTS and RATIOS under ``prefix``; columns of ``docs`` of those names are replaced.

    Only the text goes to Python, all other columns wait in the JVM.
    """
    bounded(docs.sparkSession)
    added = [prefix + c for c in (*COUNTS, *RATIOS)]
    kept = without(docs, [*added, text] if drop_text else added)
    (found,) = fresh(docs.columns, "_statistics")
    kinds = [("long", pa.int64())] * len(COUNTS) + [("double", pa.float64())] * len(RATIOS)
    fields = [pa.field(c, k) for c, (_, k) in zip((*COUNTS, *RATIOS), kinds, strict=True)]

    def compute(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(statistics(texts), fields, strict=True)], fields=fields)

    # once for each row, whatever filters follow
    counted = F.arrow_udf(compute, T.StructType([T.StructField(f.name, T.LongType() if k == "long" else T.DoubleType()) for f, (k, _) in zip(fields, kinds, strict=True)])).asNondeterministic()
    rows = docs.select(*map(quoted, kept), counted(quoted(text)).alias(found))
    return rows.select(*map(quoted, kept), *[F.col(found)[f.name].alias(name) for f, name in zip(fields, added, strict=True)])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.threshold if self.above else data[self.feature] < self.threshold

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return c >= F.lit(float(self.threshold)) if self.above else c < F.lit(float(self.threshold))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for c in rule:
        inside &= c.holds(data)
    return inside


def _cuts(values: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Midpoints between all neighbouring values, with the rows and the bad rows below each."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    at = np.flatnonzero(v[1:] != v[:-1])
    edges = (v[at] + v[at + 1]) / 2
    below = np.searchsorted(v, edges, "left")
    return edges, below, np.concatenate([[0], np.cumsum(bad[order])])[below]


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, given_up: set[tuple[str, bool]]) -> Rule:
    """Conditions of the best gain, until only bad rows are covered. The first isn't one of ``given_up``.

    Of equal gains the first feature, the smallest threshold and 'below' win.
    """
    inside, rule = np.ones(len(bad), bool), ()
    while bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for feature, values in data.items():
            edges, below, p = _cuts(values[inside], bad[inside])
            if not len(edges):
                continue
            found = np.stack([p, p0 - p], axis=1)  # below, above
            covered = np.stack([below, p0 + n0 - below], axis=1)
            gain = np.where(found > 0, found * (np.log2(np.maximum(found, 1) / np.maximum(covered, 1)) - base), 0.0)
            if not rule:
                gain[:, [(feature, above) in given_up for above in (False, True)]] = 0.0
            k = int(gain.argmax())
            if gain.flat[k] > best[0]:
                best = (gain.flat[k], Condition(feature, bool(k % 2), float(edges[k // 2])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].holds(data)
    return rule


def _prune(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix with the best (bad - good) / covered on the pruning part; the shortest of equals."""
    best, kept = -2.0, rule
    for k in range(1, len(rule) + 1):
        inside = _covered(rule[:k], data, len(bad))
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, kept = worth, rule[:k]
    return kept


def _tightest(rule: Rule) -> Rule:
    """One condition for each feature and direction."""
    kept: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        known = kept.get((c.feature, c.above))
        if known is None or (c.threshold > known.threshold) == c.above:
            kept[c.feature, c.above] = c
    return tuple(kept.values())


def learn(features: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """An ordered list of rules that reject. Rows are dealt to growing (2/3) and pruning (1/3) by position.

    A rule has to be right for ``precision`` of what it covers in the pruning part, at least one bad row, and to cover
    ``least`` bad rows in all. No rules come from a sample with one class only.
    """
    rules: list[Rule] = []
    given_up: set[tuple[str, bool]] = set()
    left, grow = np.ones(len(bad), bool), np.arange(len(bad)) % 3 != 0
    while bad[left & grow].any() and (~bad[left & grow]).any():
        growing, pruning = left & grow, left & ~grow
        rule = _grow({k: v[growing] for k, v in features.items()}, bad[growing], given_up)
        if not rule:
            break
        first = (rule[0].feature, rule[0].above)
        rule = _tightest(_prune(rule, {k: v[pruning] for k, v in features.items()}, bad[pruning]))
        inside = _covered(rule, features, len(bad)) & left
        tested = bad[inside & pruning]
        if bad[inside].sum() < least or not tested.any() or tested.sum() < precision * len(tested):
            given_up.add(first)
            continue
        rules.append(rule)
        left &= ~inside
    return rules


def reject_expression(rules: list[Rule], prefix: str = "") -> Column:
    """``CASE WHEN rule 1 THEN true ... ELSE false``, in the order of the rules."""
    chain = None
    for rule in rules:
        test = rule[0].column(prefix)
        for c in rule[1:]:
            test = test & c.column(prefix)
        chain = F.when(test, F.lit(True)) if chain is None else chain.when(test, F.lit(True))
    return F.lit(False) if chain is None else chain.otherwise(F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000, **how) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents: those of the smallest hash of the key, whatever the size."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    # the sample's bound makes it fit for a broadcast
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    found = with_statistics(rows, "_text").orderBy(F.xxhash64("_key"), "_key", "n_words", "word_chars").limit(sample).toPandas()
    return learn({c: found[c].to_numpy(float) for c in RATIOS}, (found["_label"] == 0).to_numpy(), **how)


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 20) | (repeated * 100 > n * 30)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", prefix: str = "", drop_text: bool = True) -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``, all under ``prefix``.

    NULL and empty texts have no words and fail the base rule. Every row is judged by itself, so that repeated rows
    and NULL keys need no rule of their own, and there are no ties. Columns of ``docs`` of the added names are replaced.
    """
    found = with_statistics(docs, text, prefix, drop_text)
    return found.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & ~reject_expression(rules, prefix))
