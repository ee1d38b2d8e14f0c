"""Statistics of vectors, codes and inverted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.functions.distances import as_double, norm_squared


def components(df: DataFrame, vec: str = "vec", id: str = "id") -> DataFrame:
    """(id, i, x): a row per component."""
    return df.select(id, F.posexplode(as_double(F.col(vec))).alias("i", "x"))


def dimension_stats(df: DataFrame, vec: str = "vec", id: str = "id") -> DataFrame:
    """Per dimension: n, NaN, infinite and zero entries; min, max, mean and population standard deviation of the finite."""
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    x = F.when(finite, F.col("x"))
    mean = F.avg(x)
    deviation = F.sqrt(F.greatest(F.avg(x * x) - mean * mean, F.lit(0.0)))
    return components(df, vec, id).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.isnan("x").cast("long")).alias("n_nan"), F.sum((F.abs("x") == float("inf")).cast("long")).alias("n_inf"),
        F.sum((F.col("x") == 0).cast("long")).alias("n_zero"), F.min(x).alias("min"), F.max(x).alias("max"), mean.alias("mean"), deviation.alias("stddev"))


def row_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Of the whole table: rows, valid rows (finite), zero rows, distinct rows, smallest and largest squared norm of rows that aren't zero."""
    v = as_double(F.col(vec))
    valid = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    n2 = norm_squared(F.col(vec))
    rows = df.select(valid.alias("valid"), n2.alias("n2"), F.col(vec).alias("v"))
    some = F.when(F.col("valid") & (F.col("n2") > 0), F.col("n2"))
    return rows.agg(
        F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("n_valid"), F.sum((F.col("n2") == 0).cast("long")).alias("n_zero"),
        F.count_distinct("v").alias("n_distinct"), F.min(some).alias("min_norm2"), F.max(some).alias("max_norm2"))


def imbalance(lists: DataFrame, n_lists: int | None = None, list_no: str = "list_no") -> DataFrame:
    """k * sum of squared sizes / (sum of sizes) squared; 1 is balanced. ``n_lists`` counts empty ones too."""
    sizes = lists.groupBy(list_no).agg(F.count("*").alias("n"))
    k = F.lit(n_lists) if n_lists else F.count("*")
    return sizes.agg((k * F.sum(F.col("n") * F.col("n").cast("double")) / (F.sum("n") * F.sum("n"))).alias("imbalance"))


def list_sizes(lists: DataFrame, list_no: str = "list_no") -> DataFrame:
    return lists.groupBy(list_no).agg(F.count("*").alias("n"))


def list_histogram(lists: DataFrame, list_no: str = "list_no") -> DataFrame:
    """(log2_size, n): how many lists have a size of that many bits."""
    sizes = list_sizes(lists, list_no)
    return sizes.groupBy((F.length(F.bin("n")) - 1).alias("log2_size")).agg(F.count("*").alias("n_lists"))


def bit_counts(df: DataFrame, bits: str = "bits") -> DataFrame:
    """(i, n): how often each bit of the codes is set."""
    return df.select(F.posexplode(bits).alias("i", "b")).groupBy("i").agg(F.sum("b").cast("long").alias("n"))


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def bins(df: DataFrame, column: str, low: float, high: float, n: int) -> DataFrame:
    """Counts in ``n`` equal bins; the outer ones take what is beyond."""
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(column) - low) / ((high - low) / n)))).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def hash_collisions(df: DataFrame, vec: str = "vec", bits: int = 16) -> DataFrame:
    """(n_distinct, n_hashes, n_collision): different rows that fall on one hash of ``bits`` bits."""
    digest = F.substring(F.md5(F.concat_ws(",", F.col(vec).cast("array<string>"))), 1, bits // 4)
    rows = df.select(F.col(vec).alias("v"), digest.alias("h")).distinct()
    return rows.agg(F.count("*").alias("n_distinct"), F.count_distinct("h").alias("n_hashes")).withColumn("n_collision", F.col("n_distinct") - F.col("n_hashes"))
