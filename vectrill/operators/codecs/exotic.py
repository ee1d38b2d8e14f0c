"""Lattice codes, and codes that a small trained network decodes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectrill.operators.codecs.pq import map_vectors


@lru_cache
def _atoms(dim: int, r2: int) -> tuple[tuple[int, ...], ...]:
    """Non-increasing vectors of non-negative integers with that squared norm."""
    found: list[tuple[int, ...]] = []

    def grow(start: tuple[int, ...], left: int) -> None:
        if len(start) == dim:
            if left == 0:
                found.append(start)
            return
        top = int(left**0.5)
        for v in range(min(top, start[-1]) if start else top, -1, -1):
            if v * v * (dim - len(start)) >= left:
                grow((*start, v), left - v * v)

    grow((), r2)
    return tuple(found)


def nearest_on_sphere(x: np.ndarray, r2: int) -> np.ndarray:
    """For each row, the integer point of squared norm ``r2`` with the largest inner product."""
    order = np.argsort(-np.abs(x), axis=1, kind="stable")
    ranked = np.take_along_axis(np.abs(x), order, 1)
    atoms = np.array(_atoms(x.shape[1], r2), float)
    best = atoms[(ranked @ atoms.T).argmax(axis=1)]
    out = np.zeros_like(x)
    np.put_along_axis(out, order, best, 1)
    return out * np.where(x < 0, -1.0, 1.0)


@dataclass
class Lattice:
    """``m`` parts, each as its direction (an integer point on a sphere) and its norm in 2**bits steps."""

    m: int
    r2: int
    bits: int = 4
    low: float = 0.0
    high: float = 1.0

    def fit(self, df: DataFrame, vec: str = "vec") -> Lattice:
        from vectrill.operators.transforms import sample_matrix

        x = sample_matrix(df, vec)
        norms = np.linalg.norm(x.reshape(len(x) * self.m, -1), axis=1)
        self.low, self.high = float(norms.min()), float(norms.max())
        return self

    def _encode(self, x: np.ndarray) -> np.ndarray:
        parts = x.reshape(len(x) * self.m, -1)
        norms = np.linalg.norm(parts, axis=1)
        step = (self.high - self.low) / (1 << self.bits) or 1.0
        level = np.clip(np.floor((norms - self.low) / step), 0, (1 << self.bits) - 1)
        return np.column_stack([nearest_on_sphere(parts, self.r2), level]).reshape(len(x), -1)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        parts = codes.reshape(len(codes) * self.m, -1).astype(float)
        step = (self.high - self.low) / (1 << self.bits)
        norms = self.low + (parts[:, -1] + 0.5) * step
        return (parts[:, :-1] / np.sqrt(self.r2) * norms[:, None]).reshape(len(codes), -1)

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        return map_vectors(df, lambda x: self._encode(x.astype(float)), vec, code, T.IntegerType())

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        return map_vectors(df, self._decode, code, vec, T.DoubleType())


@dataclass
class NeuralResidual:
    """Residual codes whose later codebooks are bent by what is decoded so far.

    Stage s: candidate = c + W2 relu(W1 [c, decoded]) for the codeword c. Weights are given: (codebook, W1, W2) by stage;
    the first stage's codebook is taken as it is.
    """

    stages: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]

    def _step(self, s: int, words: np.ndarray, decoded: np.ndarray) -> np.ndarray:
        _, w1, w2 = self.stages[s]
        if w1 is None:
            return words
        hidden = np.maximum(np.concatenate([words, decoded], axis=-1) @ w1.T, 0)
        return words + hidden @ w2.T

    def decode_numpy(self, codes: np.ndarray) -> np.ndarray:
        decoded = np.zeros((len(codes), self.stages[0][0].shape[1]))
        for s in range(codes.shape[1]):
            decoded = decoded + self._step(s, self.stages[s][0][codes[:, s]], decoded)
        return decoded

    def encode_numpy(self, x: np.ndarray) -> np.ndarray:
        decoded, codes = np.zeros_like(x), []
        for s, (book, _, _) in enumerate(self.stages):
            words = np.broadcast_to(book[None], (len(x), *book.shape))
            options = self._step(s, words, np.broadcast_to(decoded[:, None], words.shape))
            best = ((x[:, None] - decoded[:, None] - options) ** 2).sum(axis=2).argmin(axis=1)
            codes.append(best)
            decoded = decoded + options[np.arange(len(x)), best]
        return np.column_stack(codes)

    def encode(self, df: DataFrame, vec: str = "vec", code: str = "code") -> DataFrame:
        return map_vectors(df, lambda x: self.encode_numpy(x.astype(float)), vec, code, T.IntegerType())

    def decode(self, df: DataFrame, code: str = "code", vec: str = "vec") -> DataFrame:
        return map_vectors(df, lambda c: self.decode_numpy(c.astype(int)), code, vec, T.DoubleType())
