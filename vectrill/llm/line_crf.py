"""Document quality from a linear-chain conditional random field over lines.

Every line that has a word is a node with the labels good and bad. Its potential is linear in features of the line and
of its two neighbours, and a 2x2 table scores each pair of labels in a row. Lines have no labels of their own in
training: they are hidden, and tied to the label of their document, by ``TIE`` times their share of its characters. What is
fitted is the probability of the documents' labels, summed over all labels of the lines by forward-backward, so that
a good document may hold bad lines and a bad one good lines. A document's score is that probability: of the
length-weighted labels of its lines, and no text as a whole is looked at.

All lines of a batch are handled together: at step t, one operation serves the t-th line of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm.batches import bounded
from vectrill.llm.quality_rules import _DIGIT, _MARK, _SYMBOL, _UPPER, _repeats
from vectrill.llm.textbuf import LEAD, cut, no_nulls, runs
from vectrill.runtime import materialize

_BREAK = np.zeros(256, bool)
_BREAK[0x0A] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
OWN = 11
WIDTH = 3 * OWN + 3
TIE = 6.0


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, text) of each line with a word, in order."""
    texts = no_nulls(texts)
    rows, chars, owners = [np.zeros((0, OWN))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, stop in runs(texts):
        t, lines = cut(texts, start, stop), cut(texts, start, stop, _BREAK)
        data = t.data
        first, last = np.searchsorted(t.starts, lines.starts), np.searchsorted(t.starts, lines.ends)
        some = last > first
        begin, end, first, last, owner = lines.starts[some], lines.ends[some], first[some], last[some], lines.word_text[some]

        def inside(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[b] - sums[a]

        n = last - first
        size = inside(LEAD[data], begin, end)
        again, _ = _repeats(owner, lines.hashes[some])
        at, window = t.windows(4)
        _, many = _repeats(t.word_text[at], window)
        repeated = np.zeros(len(t.starts), bool)
        for j in range(4):
            repeated[at[many] + j] = True
        echo = np.zeros(len(t.starts), bool)
        echo[1:] = (t.hashes[1:] == t.hashes[:-1]) & (t.word_text[1:] == t.word_text[:-1])
        loud = inside(_UPPER[data], begin, end) / np.maximum(size, 1)
        rows.append(np.column_stack([
            np.minimum(inside(_SYMBOL[data], begin, end) / n, 3), inside(_SYMBOL[data], begin, end) > n / 4, loud, loud > 0.3,
            inside(_DIGIT[data], begin, end) / size, np.minimum(inside(_MARK[data], begin, end) / n, 3), inside(echo, first, last) / n, again,
            inside(repeated, first, last) / n, np.log1p(n) / 5, _STOP[data[end - 1]]]).astype(float))
        chars.append(size)
        owners.append(owner + start)
    return np.concatenate(rows), np.concatenate(chars), np.concatenate(owners)


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A constant, the line's features, and the features of the lines before and after it in its text."""
    n = len(own)
    out = np.zeros((n, WIDTH))
    out[:, 0] = 1
    if not n:
        return out
    out[:, 1 : OWN + 1] = own
    same = owner[1:] == owner[:-1]
    out[1:, OWN + 1 : 2 * OWN + 1][same] = own[:-1][same]
    out[:-1, 2 * OWN + 1 : 3 * OWN + 1][same] = own[1:][same]
    out[0, -2] = out[-1, -1] = 1
    out[1:, -2][~same] = 1
    out[:-1, -1][~same] = 1
    return out


@dataclass
class Chains:
    """Lines of texts as chains, longest first: ``at[t]`` are the t-th lines of all chains with over t lines."""

    at: list[np.ndarray]

    @classmethod
    def of(cls, owner: np.ndarray) -> Chains:
        _, begin, length = np.unique(owner, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        return cls([begin[:k] + t for t, k in enumerate(alive)])


def forward_backward(score: np.ndarray, link: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For log potentials ``score`` of good: P(good) of each line, P(label before, label) of each line but the first of a
    chain, and each line's part of its chain's log partition."""
    node = np.column_stack([np.zeros_like(score), score])
    peak = np.maximum(score, 0)
    node = np.exp(node - peak[:, None])
    pair = np.exp(link)
    ahead, scale = np.zeros_like(node), np.ones(len(node))
    for t, rows in enumerate(chains.at):
        a = node[rows] if t == 0 else (ahead[chains.at[t - 1][: len(rows)]] @ pair) * node[rows]
        scale[rows] = a.sum(axis=1)
        ahead[rows] = a / scale[rows, None]
    behind, pairs = np.ones_like(node), np.zeros((len(node), 2, 2))
    for t in range(len(chains.at) - 1, 0, -1):
        rows = chains.at[t]
        before = chains.at[t - 1][: len(rows)]
        b = node[rows] * behind[rows] / scale[rows, None]
        pairs[rows] = pair * ahead[before][:, :, None] * b[:, None, :]
        behind[before] = b @ pair.T
    both = ahead * behind
    good = both[:, 1] / both.sum(axis=1) if len(both) else np.zeros(0)
    return good, pairs, np.log(scale) + peak


def documents(score: np.ndarray, link: np.ndarray, chars: np.ndarray, owner: np.ndarray, n: int, bias: float = 0.0):
    """P(good) of each of ``n`` documents, and the hidden lines' (P(good), pairs) given a bad and given a good document."""
    chains = Chains.of(owner)
    total = np.bincount(owner, chars, n)
    tie = TIE * chars / np.maximum(total, 1)[owner] / 2
    given = [forward_backward(score + sign * 2 * tie, link, chains) for sign in (-1, 1)]
    # with the tie of bad lines to a bad document, which is the same for the good ones
    odds = np.bincount(owner, given[1][2], n) - np.bincount(owner, given[0][2], n) - np.bincount(owner, 2 * tie, n) + bias
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60))), [g[:2] for g in given]


@dataclass
class LineModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    link: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score in [0, 1] for each text; texts without words get the share of good ones in training."""
        own, chars, owner = line_features(texts)
        x = (with_neighbours(own, owner) - self.mean) / self.spread
        good, _ = documents(np.clip(x @ self.weights, -30, 30), self.link, chars, owner, len(texts), self.bias)
        return np.where(np.bincount(owner, chars, len(texts)) > 0, good, self.prior)


def train(own: np.ndarray, chars: np.ndarray, owner: np.ndarray, good: np.ndarray, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-3) -> LineModel:
    """Fit to the lines (see :func:`line_features`) of documents marked good (1) or bad (0).

    A sample with one class, or none, gives its share as every score.
    """
    good = np.asarray(good, float)
    prior = float(good.mean()) if len(good) else 0.5
    x = with_neighbours(own, owner)
    mean, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    spread[spread < 1e-6] = 1
    mean[0], spread[0] = 0, 1
    if not len(x) or good.min() == good.max():
        return LineModel(mean, spread, np.zeros(WIDTH), np.zeros((2, 2)), {0.0: -30.0, 1.0: 30.0}.get(prior if len(good) else 0.5, 0.0), prior)
    x = (x - mean) / spread
    values = [np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(1)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    some = np.bincount(owner, minlength=len(good)) > 0
    # a line is to be told by itself first, then by its neighbours
    held = np.where((np.arange(WIDTH) > OWN), 20 * ridge, ridge)
    for turn in range(1, rounds + 1):
        p, (bad_lines, good_lines) = documents(np.clip(x @ values[0], -30, 30), values[1], chars, owner, len(good), values[2][0])
        off = np.where(some, good - p, 0.0)
        gradients = (
            x.T @ (off[owner] * (good_lines[0] - bad_lines[0])) / some.sum() - held * values[0],
            (off[owner][:, None, None] * (good_lines[1] - bad_lines[1])).sum(axis=0) / some.sum() - 100 * ridge * values[1],
            off.sum(keepdims=True) / some.sum())
        for value, g, (m, v) in zip(values, gradients, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return LineModel(mean, spread, values[0], values[1], float(values[2][0]), prior)


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the key as text leaves 2 by division by 4 are kept from training; a NULL key is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 4000, lines: int = 400_000) -> LineModel:
    """Fit to at most ``sample`` labelled documents of at most ``lines`` lines in all, outside the held-out fold: those of the
    smallest hash of key and text. Lines' features reach the driver, not texts."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, chars, owner = line_features(batch.column(1))
            at = np.searchsorted(owner, np.arange(len(batch) + 1))
            packed = [(own[a:b].astype(np.float32).tobytes(), chars[a:b].astype(np.int64).tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(at)), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["h", "label", "n", "own", "chars"])

    rows = rows.select(F.xxhash64("_key", "_text").alias("h"), "_text", F.col("_label").cast("long").alias("label"))
    bounded(docs.sparkSession)
    found = materialize(rows.mapInArrow(run, "h long, label long, n long, own binary, chars binary").dropDuplicates(["h"]), "lines")
    taken, total = None, 0
    for r in found.select("h", "n").orderBy("h").limit(sample).collect():
        total += r.n
        if total > lines:
            break
        taken = r.h
    got = found.where(F.col("h") <= taken).orderBy("h").toArrow().to_pylist() if taken is not None else []
    own = np.frombuffer(b"".join(r["own"] for r in got), np.float32).reshape(-1, OWN).astype(float)
    chars = np.frombuffer(b"".join(r["chars"] for r in got), np.int64)
    return train(own, chars, np.repeat(np.arange(len(got)), [r["n"] for r in got]).astype(np.int64), np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: LineModel, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``score``, ``predicted``.

    NULL texts, empty ones and those without words get the share of good documents in training. Rows are independent:
    repeated rows get equal scores, ties don't arise, NULL keys aren't held out, and an empty table gives an empty result.
    """
    bounded(docs.sparkSession)
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], names=["_key", "score"])

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)
    return out.select(F.col("_key").alias(key), held_out("_key").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
