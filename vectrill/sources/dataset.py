"""Vector tables by descriptor: where they are, which columns hold ids and vectors, and what part of them is meant."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.functions.distances import normalized
from vectrill.operators import search


@dataclass
class VectorTable:
    """A reader of vector tables. Other columns come along as payload; rows without a vector are left out."""

    path: str
    id_column: str = "id"
    vector_column: str = "vec"
    format: str = "parquet"
    partitions: dict[str, str] = field(default_factory=dict)
    filters: list[str] = field(default_factory=list)
    sampling_rate: float | None = None
    normalize: bool = False

    def load(self, spark: SparkSession, split: tuple[int, int] = (1, 0)) -> DataFrame:
        """``split`` = (n, i): the i-th of n parts by a hash of the id."""
        df = spark.read.format(self.format).load(self.path)
        for name, value in self.partitions.items():
            df = df.where(F.col(name) == value)
        for condition in self.filters:
            df = df.where(condition)
        df = df.withColumnRenamed(self.id_column, "id").withColumnRenamed(self.vector_column, "vec").where(F.col("vec").isNotNull())
        if self.sampling_rate is not None:
            df = df.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(self.sampling_rate * 1_000_000))
        if split[0] > 1:
            df = df.where(F.pmod("id", F.lit(split[0])) == split[1])
        return df.withColumn("vec", normalized(F.col("vec"))) if self.normalize else df


@dataclass
class SearchDataset:
    """Database, queries and training vectors with their ground truth."""

    database: VectorTable
    queries: VectorTable
    training: VectorTable | None = None
    metric: str = "l2"

    def query_table(self, spark: SparkSession) -> DataFrame:
        return self.queries.load(spark).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))

    def ground_truth(self, spark: SparkSession, k: int) -> DataFrame:
        return search.knn(self.query_table(spark), self.database.load(spark), k, self.metric)

    def range_truth(self, spark: SparkSession, radius: float) -> DataFrame:
        return search.range_join(self.query_table(spark), self.database.load(spark), radius, self.metric)


def synthetic(spark: SparkSession, n: int, d: int, seed: int = 1338) -> DataFrame:
    """Vectors near a ten-dimensional surface: hash-based normal latents, mixed by fixed weights, warped by a sine.

    Every value depends on (seed, id, dimension) only, so that the table is the same on any partitioning.
    """
    def uniform(*parts) -> F.Column:
        return (F.pmod(F.xxhash64(*parts), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)

    ids = spark.range(n)
    normal = lambda j: F.sqrt(-2 * F.ln(uniform(F.lit(seed), "id", F.lit(2 * j)))) * F.cos(2 * 3.141592653589793 * uniform(F.lit(seed), "id", F.lit(2 * j + 1)))
    latent = ids.select("id", F.array(*[normal(j) for j in range(10)]).alias("z"))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate(F.transform("z", lambda z, j: z * (uniform(F.lit(seed + 1), i, j) - 0.5)), F.lit(0.0), lambda s, x: s + x))
    scaled = F.transform(mixed, lambda x, i: F.sin(x * (uniform(F.lit(seed + 2), i) * 4 + 0.1)))
    return latent.select("id", scaled.cast("array<float>").alias("vec"))
