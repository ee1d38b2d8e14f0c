"""Exact search: metrics, ranges, candidates, selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators import search as S
from vectrill.operators import selectors as W
from vectrill.plans import sql
from vectrill.plans.registry import query
from vectrill.runtime import table

Q, E = "q.embedding", "e.embedding"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(of: DataFrame, where: str = "id % 20 = 0") -> DataFrame:
    """The query set of all searches: every row whose id is divisible by 20, against all rows."""
    return of.where(where).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def _mapped(of: DataFrame, f) -> DataFrame:
    return of.withColumn("vec", f(F.col("vec"), F.col("id")))


def positive(of: DataFrame) -> DataFrame:
    return _mapped(of, lambda v, i: F.transform(v, lambda x: F.abs(x.cast("double")) + 1e-3))


def with_gaps(of: DataFrame) -> DataFrame:
    return _mapped(of, lambda v, n: F.transform(v.cast("array<double>"), lambda x, i: F.when((n + i) % 7 == 0, D.nan()).otherwise(x)))


def mixed_kinds(of: DataFrame) -> DataFrame:
    return _mapped(of, lambda v, n: F.transform(v.cast("array<double>"), lambda x, i: F.when(i < 32, F.abs(x)).otherwise(-F.floor(F.abs(x) * 20) - 1)))


POS = "list_transform({}, lambda v: abs(v::double) + 1e-3)"
GAPS = "list_transform({0}.embedding, lambda v, i: case when ({0}.vec_id + i - 1) % 7 = 0 then 'nan'::double else v::double end)"
KINDS = "list_transform({}, lambda v, i: case when i <= 32 then abs(v::double) else -floor(abs(v::double) * 20) - 1 end)"
PQ, PE = POS.format(Q), POS.format(E)

_PLAIN = {
    "l2": (None, sql.l2(Q, E), False),
    "ip": (None, sql.ip(Q, E), True),
    "cosine": (None, sql.ip(sql.normalized(Q), sql.normalized(E)), True),
    "l1": (None, sql.l1(Q, E), False),
    "linf": (None, f"list_max({sql.zipped(Q, E, 'abs({x} - {y})')})", False),
    "canberra": (None, sql.fold(sql.zipped(Q, E, sql.ratio("abs({x} - {y})", "abs({x}) + abs({y})"))), False),
    "braycurtis": (None, sql.ratio(sql.l1(Q, E), sql.fold(sql.zipped(Q, E, "abs({x} + {y})"))), False),
    "jaccard": (positive, sql.ratio(sql.fold(sql.zipped(PQ, PE, "least({x}, {y})")), sql.fold(sql.zipped(PQ, PE, "greatest({x}, {y})"))), True),
}


def _register_metric(name: str, prepare, dis: str, similarity: bool) -> None:
    @query(f"knn_{name}", sql.top(sql.cross(dis), 5, descending=similarity))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = base(spark, sf_dir)
        b = prepare(b) if prepare else b
        return S.knn(asked(b), b, 5, name)


for _name, _how in _PLAIN.items():
    _register_metric(_name, *_how)


@query("knn_lp3", sql.top(sql.cross(f"round({sql.fold(sql.zipped(Q, E, 'pow(abs({x} - {y}), 3)'))}, 6)"), 5))
def knn_lp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.knn(asked(b), b, 5, "lp", 3.0, digits=6)


_JS = sql.fold(sql.zipped(PQ, PE, "(-{x} * ln((({x} + {y}) * 0.5) / {x}) - {y} * ln((({x} + {y}) * 0.5) / {y}))"))


@query("knn_jensenshannon", sql.top(sql.cross(f"round({_JS} * 0.5, 6)"), 5))
def knn_jensenshannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = positive(base(spark, sf_dir))
    return S.knn(asked(b), b, 5, "jensenshannon", digits=6)


_GQ, _GE = GAPS.format("q"), GAPS.format("e")
_NAN_TERMS = f"list_filter({sql.zipped(_GQ, _GE, '({x} - {y}) * ({x} - {y})')}, lambda t: not isnan(t))"


@query("knn_nan_euclidean", sql.top(sql.cross(f"case when len({_NAN_TERMS}) = 0 then 'nan'::double else 64.0::double / len({_NAN_TERMS}) * {sql.fold(_NAN_TERMS)} end"), 5))
def knn_nan_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = with_gaps(base(spark, sf_dir))
    return S.knn(asked(b), b, 5, "nan_euclidean")


_GOWER_TERM = """case when isnan({x}) or isnan({y}) then null when {x} >= 0 and {y} >= 0 then (case when {x} > 1 or {y} > 1 then 'nan'::double else abs({x} - {y}) end)
 when {x} < 0 and {y} < 0 then (case when {x} <> {y} then 1.0::double else 0.0::double end) else 'nan'::double end"""
_GOWER = f"list_filter({sql.zipped(KINDS.format(Q), KINDS.format(E), _GOWER_TERM)}, lambda t: t is not null)"


@query("knn_gower", sql.top(sql.cross(f"{sql.fold(_GOWER)} / len({_GOWER})"), 5))
def knn_gower(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mixed_kinds(base(spark, sf_dir))
    return S.knn(asked(b), b, 5, "gower")


@query("range_l2", f"select * from ({sql.cross(sql.l2(Q, E))}) where dis < 1.5")
def range_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.range_join(asked(b), b, 1.5)


@query("range_ip", f"select * from ({sql.cross(sql.ip(Q, E))}) where dis > 0.2")
def range_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.range_join(asked(b), b, 0.2, "ip")


@query("range_lims", f"""select q.vec_id as qid, coalesce(n, 0)::bigint as n, sum(coalesce(n, 0)) over (order by q.vec_id)::bigint as lims from embeddings q left join
 (select qid, count(*) as n from ({sql.cross(sql.l2(Q, E))}) where dis < 1.5 group by qid) r on r.qid = q.vec_id where q.vec_id % 20 = 0""")
def range_lims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result sizes and their running sum, as offsets into the concatenated results."""
    b = base(spark, sf_dir)
    n = S.range_join(asked(b), b, 1.5).groupBy("qid").agg(F.count("*").alias("n"))
    every = asked(b).select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return every.withColumn("lims", F.sum("n").over(Window.orderBy("qid")))


@query("pairwise_l2", f"select q.vec_id as qid, e.vec_id as id, {sql.l2(Q, E)} as dis from embeddings q, embeddings e where q.vec_id % 20 = 0")
def pairwise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.all_pairs(asked(b), b)


@query("l2_from_product", f"select q.vec_id as qid, e.vec_id as id, {sql.norm2(Q)} + {sql.norm2(E)} - 2 * {sql.ip(Q, E)} as dis from embeddings q, embeddings e where q.vec_id % 20 = 0")
def l2_from_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.pairs_from_product(asked(b), b)


@query("assign_nearest", f"select qid, id from (select *, row_number() over (partition by qid order by dis, id) as r from ({sql.cross(sql.l2(Q, E), 'e.vec_id < 16', 'true')})) where r = 1")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.assign(asked(b, "true"), b.where("id < 16"))


@query("vector_norms", f"select vec_id as id, sqrt({sql.norm2('embedding')}) as norm, {sql.norm2('embedding')} as norm_squared from embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", D.norm(F.col("vec")).alias("norm"), D.norm_squared(F.col("vec")).alias("norm_squared"))


@query("normalize_l2", f"select vec_id as id, {sql.normalized('list_transform(embedding, lambda v: v::double * 3)')} as vec from embeddings")
def normalize_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", D.normalized(F.transform(D.as_double(F.col("vec")), lambda x: x * 3)).alias("vec"))


@query("vec_add_sub_madd", f"""select q.vec_id as id, {sql.zipped(Q, E, '{x} + {y}')} as added, {sql.zipped(Q, E, '{x} - {y}')} as subtracted,
 {sql.zipped(Q, E, '{x} + 0.5::double * {y}')} as scaled, list_transform(q.embedding, lambda v: v::double + 2.0::double) as shifted
 from embeddings q join embeddings e on e.vec_id = q.vec_id + 1""")
def vec_add_sub_madd(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    pairs = b.join(b.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    x, y = F.col("vec"), F.col("other")
    return pairs.select("id", V.add(x, y).alias("added"), V.subtract(x, y).alias("subtracted"), V.add_scaled(x, 0.5, y).alias("scaled"), V.add_scalar(x, 2.0).alias("shifted"))


_MADD = sql.zipped(Q, E, "{x} + 0.5::double * {y}")


@query("madd_argmin", f"select q.vec_id as id, (list_position({_MADD}, list_min({_MADD})) - 1)::int as at from embeddings q join embeddings e on e.vec_id = q.vec_id + 1")
def madd_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    pairs = b.join(b.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    return pairs.select("id", V.add_scaled_argmin(F.col("vec"), 0.5, F.col("other")).alias("at"))


@query("row_k_least", """select id, (row_number() over (partition by id order by x, i))::int as rank, i, x from
 (select vec_id as id, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings) qualify rank <= 3""")
def row_k_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", F.posexplode(V.k_least(F.col("vec"), 3)).alias("r", "p")).select("id", (F.col("r") + 1).alias("rank"), "p.i", "p.x")


_CANDIDATES = "select q.vec_id as qid, e.vec_id as id from embeddings q, embeddings e where q.vec_id % 20 = 0 and e.vec_id % 20 = (q.vec_id // 20) % 20"


def _candidates(b: DataFrame) -> DataFrame:
    q = asked(b).select("qid", F.floor(F.col("qid") / 20 % 20).alias("_k"))
    return b.select("id", (F.col("id") % 20).alias("_k")).join(q, "_k").select("qid", "id")


@query("knn_subset_candidates", sql.top(f"select qid, id, {sql.l2(Q, E)} as dis from ({_CANDIDATES}) c join embeddings q on q.vec_id = c.qid join embeddings e on e.vec_id = c.id", 4))
def knn_subset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.knn_among(_candidates(b), asked(b), b, 4)


@query("distances_by_index", f"select qid, id, {sql.ip(Q, E)} as dis from ({_CANDIDATES}) c join embeddings q on q.vec_id = c.qid join embeddings e on e.vec_id = c.id")
def distances_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.distances_to(_candidates(b), asked(b), b, "ip")


@query("search_and_reconstruct", f"select r.*, embedding as vec from ({sql.top(sql.cross(sql.l2(Q, E)), 3)}) r join embeddings on vec_id = id")
def search_and_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.with_vectors(S.knn(asked(b), b, 3), b)


def _register_selector(name: str, selector, where: str) -> None:
    @query(f"knn_sel_{name}", sql.top(sql.cross(sql.l2(Q, E), where), 5))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = base(spark, sf_dir)
        return S.knn(asked(b), b, 5, selector=selector(b))


_BITMAP = bytes((i * 37 + 11) % 256 for i in range(40))
_BITS = ", ".join(str(b) for b in _BITMAP)
for _n, _selector, _where in (
    ("all", lambda b: W.All(), "true"),
    ("range", lambda b: W.IdRange(100, 300), "e.vec_id >= 100 and e.vec_id < 300"),
    ("array", lambda b: W.IdArray([3, 1, 4, 15, 92, 65, 35, 89]), "e.vec_id in (3, 1, 4, 15, 92, 65, 35, 89)"),
    ("batch", lambda b: W.IdBatch(b.where("label in (1, 3)").select("id")), "e.label in (1, 3)"),
    ("bitmap", lambda b: W.IdBitmap(_BITMAP), f"e.vec_id < 320 and (([{_BITS}])[e.vec_id // 8 + 1] >> (e.vec_id % 8)::int) & 1 = 1"),
    ("not", lambda b: ~W.IdRange(20, 400), "not (e.vec_id >= 20 and e.vec_id < 400)"),
    ("not_batch", lambda b: ~W.IdBatch(b.where("label = 1").select("id")), "e.label <> 1"),
    ("and_or_xor", lambda b: (W.IdRange(0, 200) & W.IdRange(100, 300)) | (W.IdRange(300, 400) ^ W.IdRange(350, 450)),
     "((e.vec_id between 100 and 199) or ((e.vec_id between 300 and 399) <> (e.vec_id between 350 and 449)))"),
    ("callback", lambda b: W.Callback(lambda i: i % 3 == 1), "e.vec_id % 3 = 1"),
    ("translated", lambda b: W.Translated(W.IdRange(2, 5), "label"), "e.label >= 2 and e.label < 5"),
):
    _register_selector(_n, _selector, _where)


@query("knn_idmap", sql.top(sql.cross(sql.l2(Q, E)).replace("e.vec_id as id", "e.vec_id * 7 + 1000 as id"), 5))
def knn_idmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids are just the id column."""
    b = base(spark, sf_dir)
    return S.knn(asked(b), b.withColumn("id", F.col("id") * 7 + 1000), 5)


_RANGED = f"select * from ({sql.cross(sql.l2(Q, E))}) where dis < 1.8"


@query("range_max_results", f"""with r as ({_RANGED}), o as (select dis, row_number() over (order by dis) as p from r)
select r.* from r where not exists (select 1 from o where p = 101) or dis < (select dis from o where p = 101)""")
def range_max_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.range_limited(asked(b), b, 1.8, 100)


@query("knn_matrix", sql.top(sql.cross(sql.l2(Q, E)), 10).replace("id, dis", "id, round(dis, 6) as dis"))
def knn_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.knn_blocks(asked(b), b, 10).withColumn("dis", F.round("dis", 6) + F.lit(0.0))


_SHARDS = " union all ".join(f"(select qid, id, dis from ({sql.top(sql.cross(sql.l2(Q, E), f'e.vec_id % 4 = {s}'), 5)}))" for s in range(4))


@query("shards_merge_topk", sql.top(_SHARDS, 5))
def shards_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return S.merge_results([S.knn(asked(b), b.where(F.col("id") % 4 == s), 5) for s in range(4)], 5)
