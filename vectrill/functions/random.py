"""Reproducible pseudo-random columns and checksums: functions of a seed and the row only, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from 32 bits of a digest of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def integers(seed: int, below: int, *parts: Column) -> Column:
    return F.floor(uniform(seed, *parts) * below).cast("long")


def normal(seed: int, *parts: Column) -> Column:
    """Box-Muller over two uniform numbers."""
    u = 1 - uniform(seed, F.lit("u"), *parts)
    return F.sqrt(-2 * F.ln(u)) * F.cos(uniform(seed, F.lit("v"), *parts) * 6.283185307179586)


def random_vector(seed: int, d: int, id: Column) -> Column:
    return F.array(*[uniform(seed, id, F.lit(i)) for i in range(d)])


def smooth_vector(seed: int, d: int, id: Column, latent: int = 10) -> Column:
    """Vectors near a surface of few dimensions: mixed latent normals through a sine."""
    z = [normal(seed, id, F.lit(j)) for j in range(latent)]
    out = []
    for i in range(d):
        total = F.lit(0.0)
        for j in range(latent):
            total = total + z[j] * (uniform(seed + 1, F.lit(i), F.lit(j)) - 0.5)
        out.append(F.sin(total * (uniform(seed + 2, F.lit(i)) * 4 + 0.1)))
    return F.array(*out)


def permuted(df: DataFrame, seed: int, id: str = "id") -> Column:
    """A sort key that puts the rows in a random order."""
    return uniform(seed, F.col(id))


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """(n, checksum): a sum of row hashes, the same for any order of rows."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"))


def vector_checksum(df: DataFrame, vec: str = "codes") -> DataFrame:
    """Position-weighted sum of integer codes, and their plain sum: (n, total, weighted)."""
    weighted = F.aggregate(F.transform(vec, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    total = F.aggregate(F.transform(vec, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.sum(weighted).alias("weighted"))
