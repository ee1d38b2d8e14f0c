"""Descriptions end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrill.operators.selectors import IdRange
from vectrill.plans import factory, sql
from vectrill.plans.index_queries import _HAMMING, _HPAIRS, bits
from vectrill.plans.registry import query
from vectrill.plans.search_queries import E, Q, asked, base

_EXACT = sql.top(sql.cross(sql.l2(Q, E)), 5)


def _register(name: str, text: str, oracle: str | None = None, binary: bool = False, **how) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = base(spark, sf_dir).select("id", "vec")
        b = bits(b) if binary else b
        return factory.build(text, b, rounds=4).search(asked(b), 5, **how)


_register("factory_flat", "Flat", _EXACT)
_register("factory_idmap_flat", "IDMap,Flat", _EXACT)
_register("factory_flat_selector", "Flat", sql.top(sql.cross(sql.l2(Q, E), "e.vec_id >= 50 and e.vec_id < 250"), 5), selector=IdRange(50, 250))
_register("factory_panorama", "FlatL2Panorama4", _EXACT)
_register("factory_ivf_all_lists", "IVF8,Flat", _EXACT, nprobe=8)
_register("factory_sq8_refined", "SQ8,RFlat", _EXACT, k_factor=20)
# a finite factor cuts candidates off in larger tables, and the SQL has none cut off
_register("factory_pq_refined_all", "PQ8x4,RFlat", _EXACT, k_factor=float("inf"))
_register("factory_lsh", "LSH64", sql.top(_HPAIRS, 5))
_register("factory_binary_flat", "BFlat", sql.top(_HPAIRS, 5), binary=True)
_register("factory_binary_ivf_all", "BIVF4", sql.top(_HPAIRS, 5), binary=True, nprobe=4)
_register("factory_binary_hash", "BHash8", sql.top(sql.cross(_HAMMING, "list_sum(list_transform(list_zip(q.embedding[1:8], e.embedding[1:8]), lambda z: case when (z[1] >= 0) <> (z[2] >= 0) then 1 else 0 end)) <= 2"), 5), binary=True, flips=2)
_register("factory_pca_ivf_sq8", "PCA32,IVF8,SQ8,RFlat", nprobe=7, k_factor=60)
_register("factory_opq_ivf_pq", "OPQ8_32,IVF8,PQ8x4,RFlat", nprobe=7, k_factor=120)
_register("factory_ivf_rabitq", "IVF8,RaBitQ,RFlat", nprobe=7, k_factor=60)
_register("factory_hnsw", "HNSW16,Flat")
_register("factory_nsg", "NSG16,Flat")
_register("factory_imi", "IMI2x3,Flat", nprobe=48)
_register("factory_rq", "RQ4x4,RFlat", k_factor=160)
_register("factory_lattice", "ZnLattice8x10_4,RFlat", k_factor=8)
