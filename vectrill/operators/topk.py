"""Top-k per query: rank by distance, then by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(pairs: DataFrame, k: int, by: str = "dis", query: str = "qid", tie: str = "id", descending: bool = False) -> DataFrame:
    """Keep the best ``k`` rows of each query. The plan has a partial WindowGroupLimit ahead of its shuffle."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    w = Window.partitionBy(query).orderBy(order, F.col(tie).asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
