"""Graph search, further codecs, streams and saved indexes: checked by tests, as SQL can't express most of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.operators import evaluate as Ev
from vectrill.operators import graph as G
from vectrill.operators import search as S
from vectrill.operators.codecs.exotic import Lattice, NeuralResidual
from vectrill.operators.codecs.pq import LocalSearchQuantizer, ProductQuantizer, ResidualQuantizer, SplitCodec, polysemous_order
from vectrill.plans.index_queries import index
from vectrill.plans.registry import query
from vectrill.plans.search_queries import asked, base
from vectrill.runtime import shared_dir, table
from vectrill.sources import store
from vectrill.streaming import window as T


@query("hnsw_search")
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return G.graph_knn(asked(b), b, 10)


@query("hnsw_recall")
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return Ev.knn_intersection(G.graph_knn(asked(b), b, 10), S.knn(asked(b), b, 10), 10)


@query("nsg_recall")
def nsg_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return Ev.knn_intersection(G.graph_knn(asked(b), b, 10, kind="nsg"), S.knn(asked(b), b, 10), 10)


@query("hnsw_edges")
def hnsw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_edges(base(spark, sf_dir), 8)


@query("nndescent_graph")
def nndescent_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbour_descent(base(spark, sf_dir), 10)


def _error(decoded: DataFrame) -> DataFrame:
    from vectrill.functions.distances import l2

    return decoded.select("id", F.round(l2(F.col("vec"), F.col("near")), 6).alias("error"))


def _register_codec(name: str, make) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Squared error of each vector's reconstruction."""
        b = base(spark, sf_dir).select("id", "vec")
        codec = make(b)
        return _error(codec.decode(codec.encode(b), vec="near"))


def _neural(b: DataFrame) -> NeuralResidual:
    rq = ResidualQuantizer(2, 4).fit(b)
    rng = np.random.default_rng(0)
    d = rq.books[0].shape[1]
    return NeuralResidual([(rq.books[0], None, None), (rq.books[1], rng.normal(0, 0.01, (8, 2 * d)), rng.normal(0, 0.01, (d, 8)))])


_register_codec("pq_trained", lambda b: ProductQuantizer(8, 5).fit(b))
_register_codec("pq_shared", lambda b: ProductQuantizer(8, 5, how="shared").fit(b))
_register_codec("pq_hypercube", lambda b: ProductQuantizer(8, 5, how="hypercube").fit(b))
_register_codec("rq_encode", lambda b: ResidualQuantizer(4, 4).fit(b, refine=1))
_register_codec("lsq_encode", lambda b: LocalSearchQuantizer(4, 4, rounds=2).fit(b))
_register_codec("prq_encode", lambda b: SplitCodec([ResidualQuantizer(2, 4), ResidualQuantizer(2, 4)]).fit(b))
_register_codec("lattice_encode", lambda b: Lattice(8, 10).fit(b))
_register_codec("qinco_decode", _neural)


@query("polysemous_training")
def polysemous_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, code, place): centroid numbers arranged so that Hamming distances follow real ones."""
    pq = ProductQuantizer(2, 4).fit(base(spark, sf_dir))
    return spark.createDataFrame([(m, i, int(p)) for m, book in enumerate(pq.books) for i, p in enumerate(polysemous_order(book, 2000))], "part int, code int, place int")


@query("knn_self_graph", """select src, rank::int as rank, dst, dis from (select *, row_number() over (partition by src order by dis, dst) as rank from (select q.vec_id as src, e.vec_id as dst,
 list_reduce(list_prepend(0.0::double, list_transform(list_zip(q.embedding, e.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))), lambda s, x: s + x) as dis
 from embeddings q, embeddings e where q.vec_id <> e.vec_id and q.vec_id % 20 = 0)) where rank <= 3""")
def knn_self_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    pairs = S.all_pairs(asked(b), b).where("qid <> id")
    return S.top_k(pairs, 3).select(F.col("qid").alias("src"), "rank", F.col("id").alias("dst"), "dis")


@query("sliding_window_step", "select vec_id as id, (vec_id * 10 // n)::int as slice_id from embeddings, (select count(*) as n from embeddings) where vec_id * 10 // n >= 7")
def sliding_window_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in ten slices; the last three are alive in the end."""
    b = base(spark, sf_dir)
    n = b.count()
    index_ = T.SlidingIndex(spark, f"{shared_dir(spark)}/sliding-{np.random.default_rng().integers(1 << 60)}")
    for s in range(10):
        index_.step(b.where(F.floor(F.col("id") * 10 / n) == s).select("id"), remove_oldest=s >= 3)
    return index_.rows().select("id", F.col("slice_id").cast("int").alias("slice_id"))


@query("stream_add_evict", "select step, greatest(0, high + 1 - 200)::bigint as low, high, (high + 1 - greatest(0, high + 1 - 200))::bigint as n from (select vec_id // 20 as step, max(vec_id) as high from embeddings group by 1)")
def stream_add_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.replay_count_window(base(spark, sf_dir).select("id"), 200, 20)


@query("stream_assign_window", """with a as (select time_bucket(interval '1 hour', ts) as begin, case when abs(value - 20.0) <= abs(value - 80.0) then 0 else 1 end as list_no, least((value - 20.0) * (value - 20.0), (value - 80.0) * (value - 80.0)) as dis from events)
select begin, list_no, count(*) as n, round(avg(dis) + 1e-7, 4) as mean_dis from a group by all""")
def stream_assign_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of one-dimensional vectors assigned to two centroids."""
    events = table(spark, sf_dir, "events").select("ts", F.array("value").alias("vec"))
    return T.windowed_assignments(events, np.array([[20.0], [80.0]]), "1 hour").withColumn("mean_dis", F.round(F.col("mean_dis") + 1e-7, 4))


@query("save_load_inverted", "select vec_id as id from embeddings")
def save_load_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/inverted-{np.random.default_rng().integers(1 << 60)}"
    store.save_inverted(index(base(spark, sf_dir)), path)
    return store.load_inverted(spark, path).lists.select("id")
