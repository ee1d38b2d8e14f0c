"""Random columns, checksums, reordering, two-view inverted files, sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions import random as R
from vectrill.operators import ivf as I
from vectrill.operators import sets as U
from vectrill.operators import stats as A
from vectrill.plans import sql
from vectrill.plans.registry import query
from vectrill.plans.search_queries import asked, base
from vectrill.plans.table_queries import lists
from vectrill.runtime import shared_dir
from vectrill.sources import dataset, vecs

_UNIFORM = "(('0x' || substr(md5('{seed}:' || {parts}), 1, 8))::bigint::double / 4294967296.0::double)"


@query("random_uniform", f"select vec_id as id, {_UNIFORM.format(seed=5, parts='vec_id')} as u, floor({_UNIFORM.format(seed=6, parts='vec_id')} * 100)::bigint as i from embeddings")
def random_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", R.uniform(5, F.col("id")).alias("u"), R.integers(6, 100, F.col("id")).alias("i"))


@query("random_permutation", f"select vec_id as id, row_number() over (order by {_UNIFORM.format(seed=9, parts='vec_id')}, vec_id) as place from embeddings")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id")
    keyed = b.select("id", F.struct(R.permuted(b, 9).alias("u"), "id").alias("order"))
    return U.with_positions(keyed, "place", "order").select("id", (F.col("place") + 1).alias("place"))


@query("random_vectors", f"select vec_id as id, [{', '.join(_UNIFORM.format(seed=3, parts=f'''vec_id || ':{i}' ''') for i in range(4))}] as vec from embeddings")
def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", R.random_vector(3, 4, F.col("id")).alias("vec"))


@query("smooth_vectors")
def smooth_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", R.smooth_vector(3, 8, F.col("id"), 4).alias("vec"))


@query("synthetic_dataset")
def synthetic_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.synthetic(spark, 1000, 16)


@query("code_checksum", "select count(*) as n, sum(list_sum(c))::bigint as total, sum(list_sum(list_transform(c, lambda x, i: x * i)))::bigint as weighted from (select list_transform(embedding, lambda v: floor(v::double * 100)::bigint) as c from embeddings)")
def code_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_checksum(base(spark, sf_dir).select(F.transform("vec", lambda x: F.floor(x.cast("double") * 100)).alias("codes")))


@query("row_checksum")
def row_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.checksum(base(spark, sf_dir), "id", "vec")


@query("hash_collisions", "select count(*) as n_distinct, count(distinct h) as n_hashes, count(*) - count(distinct h) as n_collision from (select distinct r, substr(md5(r::varchar), 1, 2) as h from (select floor(embedding[1]::double * 1000)::bigint as r from embeddings))")
def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hash_collisions(base(spark, sf_dir).select(F.array(F.floor(F.col("vec")[0].cast("double") * 1000)).alias("vec")), bits=8)


@query("lists_by_size", """with s as (select label, row_number() over (order by count(*) desc, label) - 1 as p from embeddings group by label)
select vec_id as id, label as old_list_no, p::int as list_no from embeddings join s using (label)""")
def lists_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lists_by_size(lists(spark, sf_dir)).select("id", "old_list_no", "list_no")


@query("reorder_rows", "select (select count(*) from embeddings) - 1 - vec_id as id, label from embeddings")
def reorder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "label")
    return U.reorder(b, b.select("id", (b.count() - 1 - F.col("id")).alias("new_id")))


_HALF = "list_transform({}, lambda v: v::double)"


@query("ivf_two_views", f"""with c as (select vec_id::int as list_no, {_HALF.format('embedding[1:16]')} as c from embeddings where vec_id < 8),
own as materialized (select vec_id as id, embedding as vec, list_no from embeddings, c qualify row_number() over (partition by vec_id order by {sql.l2('embedding[1:16]', 'c')}, list_no) = 1),
p as materialized (select vec_id as qid, embedding as qvec, list_no from embeddings, c where vec_id % 20 = 0 qualify row_number() over (partition by vec_id order by {sql.l2('embedding[1:16]', 'c')}, list_no) <= 3)
{sql.top('select qid, own.id, ' + sql.l2('qvec', 'vec') + ' as dis from p join own using (list_no)', 5)}""")
def ivf_two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse quantizer sees the first 16 dimensions only."""
    b = base(spark, sf_dir).select("id", "vec", D.as_double(F.slice("vec", 1, 16)).alias("coarse_vec"))
    centroids = np.array([r["coarse_vec"] for r in b.where("id < 8").orderBy("id").collect()])
    q = b.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("coarse_vec").alias("qcoarse"))
    return I.search_two_views(q, b, centroids, 5, 3)


@query("random_results")
def random_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.random_results(asked(base(spark, sf_dir)), 500, 5)


@query("vecs_round_trip", "select vec_id as id, embedding as vec from embeddings")
def vecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as fvecs in the shared folder, in the order of ids, and read in byte ranges."""
    path = f"{shared_dir(spark).removeprefix('file:')}/vecs-{np.random.default_rng().integers(1 << 60)}"
    vecs.write(base(spark, sf_dir).select("id", "vec").repartitionByRange(3, "id").sortWithinPartitions("id"), path)
    return vecs.read(spark, path, "fvecs", 100)
