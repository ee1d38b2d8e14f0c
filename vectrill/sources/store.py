"""Saved indexes: rows as Parquet, partitioned by list where there are lists, and models as JSON beside them.

Reading is lazy: loading an index reads its model only; rows are read by the searches, which prune lists.
"""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vectrill.operators import transforms
from vectrill.operators.clustering import KMeans
from vectrill.operators.codecs import pq, scalar
from vectrill.operators.ivf import Inverted

_CLASSES = {c.__name__: c for c in (
    transforms.Linear, transforms.PCA, transforms.ITQ, transforms.OPQ, transforms.Remap, transforms.Normalize, transforms.Center, transforms.Chain, KMeans,
    scalar.ScalarQuantizer, scalar.DirectBytes, scalar.HalfPrecision, scalar.RowMinMax, scalar.SignBits, scalar.SpectralBits,
    pq.ProductQuantizer, pq.ResidualQuantizer, pq.LocalSearchQuantizer, pq.SplitCodec, pq.RefinedProduct)}


def to_json(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if is_dataclass(value) and not isinstance(value, type):
        return {"model": type(value).__name__, "fields": {f.name: to_json(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if isinstance(value, (np.integer, np.floating)):
        return value.item()
    if value is None or isinstance(value, (bool, int, float, str, dict)):
        return value
    raise TypeError(f"a {type(value).__name__} can't be saved")


def from_json(value: Any) -> Any:
    if isinstance(value, dict) and "array" in value:
        return np.array(value["array"])
    if isinstance(value, dict) and "model" in value:
        return _CLASSES[value["model"]](**{k: from_json(v) for k, v in value["fields"].items()})
    if isinstance(value, list):
        return [from_json(v) for v in value]
    return value


def _put(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    _put(spark, path, to_json(model))


def load_model(spark: SparkSession, path: str) -> Any:
    return from_json(_get(spark, path))


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def save_inverted(index: Inverted, path: str, mode: str = "errorifexists") -> None:
    index.lists.write.mode(mode).partitionBy("list_no").parquet(f"{path}/lists")
    index.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _put(index.lists.sparkSession, f"{path}/model", {"which": index.which, "residual": index.residual})


def load_inverted(spark: SparkSession, path: str) -> Inverted:
    about = _get(spark, f"{path}/model")
    return Inverted(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/lists"), about["which"], about["residual"])


def merge_inverted(spark: SparkSession, paths: list[str], target: str) -> Inverted:
    """Shards with the same centroids into one saved index."""
    parts = [load_inverted(spark, p) for p in paths]
    tables = [[(r["list_no"], list(r["centroid"])) for r in p.centroids.orderBy("list_no").collect()] for p in parts]
    if any(t != tables[0] for t in tables):
        raise ValueError("the shards don't have the same centroids")
    lists = parts[0].lists
    for p in parts[1:]:
        lists = lists.unionByName(p.lists)
    save_inverted(Inverted(parts[0].centroids, lists, parts[0].which, parts[0].residual), target)
    return load_inverted(spark, target)
