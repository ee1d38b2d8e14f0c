"""Transforms, codecs, clustering, inverted files, binary codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions import vectors as V
from vectrill.operators import binary as B
from vectrill.operators import clustering as C
from vectrill.operators import ivf as I
from vectrill.operators import search as S
from vectrill.operators import transforms as P
from vectrill.operators.codecs import rabitq
from vectrill.operators.codecs.pq import ProductQuantizer, ResidualQuantizer
from vectrill.operators.codecs.scalar import DirectBytes, HalfPrecision, RowMinMax, ScalarQuantizer, SignBits, SpectralBits
from vectrill.operators.topk import top_k
from vectrill.plans import sql
from vectrill.plans.registry import query
from vectrill.plans.search_queries import E, Q, asked, base

# ---- transforms


@query("remap_dims", "select vec_id as id, list_transform([3, 1, 0, 2, 63, 60], lambda j: case when j = 0 then 0.0::double else embedding[j]::double end) as vec from embeddings")
def remap_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.Remap([2, 0, -1, 1, 62, 59]).apply(base(spark, sf_dir)).select("id", "vec")


_MEAN = "(select list(m order by i) from (select i, round(avg(x), 6) as m from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by i))"


@query("centering", f"with m as materialized (select {_MEAN} as m) select vec_id as id, {sql.zipped('embedding', 'm', '{x} - {y}')} as vec from embeddings, m")
def centering(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return P.Center(digits=6).fit(b).apply(b).select("id", "vec")


_MATRIX = [[round(((i * 7 + j * 13) % 11 - 5) / 5, 3) for j in range(64)] for i in range(4)]
_BIAS = [0.5, -1.0, 0.0, 2.0]
_ROWS = ", ".join(f"{sql.fold(sql.zipped(str([float(x) for x in r]) + '::double[]', 'embedding', '{x} * {y}'))} + {b}::double" for r, b in zip(_MATRIX, _BIAS, strict=True))


@query("linear_transform", f"select vec_id as id, [{_ROWS}] as vec from embeddings")
def linear_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.Linear(np.array(_MATRIX), np.array(_BIAS)).apply(base(spark, sf_dir)).select("id", "vec")


@query("pca_mean_cov", """with x as (select vec_id, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings), c as (select * from x)
select a.i, b.i as j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 6) + 0.0 as cov from c a join c b using (vec_id) group by all""")
def pca_mean_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    _, cov, _ = P.mean_and_covariance(b)
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double").withColumn("cov", F.round("cov", 6) + F.lit(0.0))


@query("pca_whiten")
def pca_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per axis mean and variance of whitened vectors: 0 and 1."""
    b = base(spark, sf_dir)
    out = P.PCA(16, power=-0.5).fit(b).apply(b)
    return out.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.var_pop("x"), 4).alias("variance"))


@query("transform_chain", f"select vec_id as id, {sql.normalized('list_transform([2, 3, 1, 0], lambda j: case when j = 0 then 0.0::double else embedding[j]::double end)')} as vec from embeddings")
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return P.Chain([P.Remap([1, 2, 0, -1]), P.Normalize()]).fit(b).apply(b).select("id", "vec")


@query("random_rotation")
def random_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation keeps norms."""
    b = base(spark, sf_dir)
    out = P.random_rotation(64).apply(b)
    return out.select("id", F.round(D.norm_squared(F.col("vec")), 5).alias("norm2"))


@query("itq_codes")
def itq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    return P.ITQ(16).fit(b).apply(b).select("id", V.pack_words(V.bits_of(F.col("vec")), 16).alias("code"))


@query("opq")
def opq(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    rotation = P.OPQ(8, rounds=5).fit(b)
    turned = rotation.apply(b)
    return ProductQuantizer(8, 4).fit(turned).encode(turned).select("id", "code")


# ---- scalar codecs

_COMPONENTS = "select vec_id as id, label, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as i from embeddings"


def _ranges(low: str, width: str) -> str:
    return f"select i, {low} as low, {width} as width from ({_COMPONENTS}) group by i"


def _trained(spark: SparkSession, sq: ScalarQuantizer) -> DataFrame:
    return spark.createDataFrame([(i, float(l), float(w)) for i, (l, w) in enumerate(zip(sq.low, sq.width, strict=True))], "i int, low double, width double")


@query("sq8_train_minmax", _ranges("min(x)", "max(x) - min(x)"))
def sq8_train_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, ScalarQuantizer(8).fit(base(spark, sf_dir)))


@query("sq8_train_meanstd", _ranges("round(avg(x) - stddev_pop(x) * 2.0, 6)", "round(stddev_pop(x) * 4.0, 6)"))
def sq8_train_meanstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, ScalarQuantizer(8, range_from="meanstd", argument=2.0, digits=6).fit(base(spark, sf_dir)))


@query("sq8_train_quantiles", _ranges("round(quantile_cont(x, 0.05), 6)", "round(quantile_cont(x, 0.95) - quantile_cont(x, 0.05), 6)"))
def sq8_train_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, ScalarQuantizer(8, range_from="quantiles", argument=0.05, digits=6).fit(base(spark, sf_dir)))


def _sq_sql(steps: int, uniform: bool = False) -> str:
    r = f"select min(x) as low, max(x) - min(x) as width from ({_COMPONENTS})" if uniform else _ranges("min(x)", "max(x) - min(x)")
    join = f"({_COMPONENTS}), r" if uniform else f"({_COMPONENTS}) join r using (i)"
    return f"""with r as ({r}), c as (select id, i, low, width, floor(least(greatest(case when width = 0 then 0.0 else (x - low) / width end, 0.0), 1.0) * {steps})::int as code from {join})
select id, list(code order by i) as code, list(low + (code::double + 0.5) / {steps} * width order by i) as vec from c group by id"""


def _register_sq(name: str, bits: int, uniform: bool = False) -> None:
    @query(name, _sq_sql((1 << bits) - 1, uniform))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = base(spark, sf_dir).select("id", "vec")
        sq = ScalarQuantizer(bits, uniform).fit(b)
        return sq.decode(sq.encode(b)).select("id", "code", "vec")


for _n, _b, _u in (("sq8_roundtrip", 8, False), ("sq4_roundtrip", 4, False), ("sq6_roundtrip", 6, False), ("sq8_uniform", 8, True), ("sq4_uniform", 4, True)):
    _register_sq(_n, _b, _u)


@query("knn_sq8", sql.top(f"with s as ({_sq_sql(255)}) select q.vec_id as qid, s.id, {sql.l2('q.embedding', 's.vec')} as dis from embeddings q, s where q.vec_id % 20 = 0", 5))
def knn_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    sq = ScalarQuantizer(8).fit(b)
    return S.knn(asked(b), sq.decode(sq.encode(b)), 5)


@query("sq8_direct", "select vec_id as id, list_transform(embedding, lambda v: (floor(v::double * 100) + 128)::int) as code, list_transform(embedding, lambda v: floor(v::double * 100)) as vec from embeddings")
def sq8_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", F.transform("vec", lambda x: F.floor(x.cast("double") * 100).cast("double")).alias("vec"))
    codec = DirectBytes(signed=True)
    return codec.decode(codec.encode(b)).select("id", "code", "vec")


@query("half_precision")
def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest relative error of both 16-bit floats."""
    b = base(spark, sf_dir).select("id", "vec")
    out = None
    for name, brain in (("half", False), ("brain", True)):
        codec = HalfPrecision(brain)
        done = codec.decode(codec.encode(b.withColumn("x", F.col("vec"))), vec="y").select(F.lit(name).alias("kind"), "id", F.round(D.linf(F.col("x"), F.col("y")), 6).alias("error"))
        out = done if out is None else out.union(done)
    return out


@query("rowwise_minmax", """with r as (select id, min(x) as low, max(x) - min(x) as scale from (""" + _COMPONENTS + """) group by id),
c as (select id, i, low, scale, floor(least(greatest((x - low) / scale, 0.0), 1.0) * 255)::int as code from (""" + _COMPONENTS + """) join r using (id))
select id, any_value(scale) as scale, any_value(low) as low, list(code order by i) as code, list((0.0::double + (code::double + 0.5) / 255 * 1.0) * scale + low order by i) as vec from c group by id""")
def rowwise_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    codec = RowMinMax()
    return codec.decode(codec.encode(b)).select("id", "scale", "low", "code", "vec")


_PACK = "list_sum(list_transform({}, lambda b, i: case when b then ((1::hugeint) << (i - 1)::int) else 0::hugeint end))"


def _signed(bits: str) -> str:
    packed = _PACK.format(bits)
    return f"[(case when {packed} >= 9223372036854775808::hugeint then {packed} - 18446744073709551616::hugeint else {packed} end)::bigint]"


@query("lsh_codes", f"select vec_id as id, {_signed('list_transform(embedding, lambda v: v >= 0)')} as code from embeddings")
def lsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SignBits(64).fit(base(spark, sf_dir)).encode(base(spark, sf_dir)).select("id", "code")


@query("lsh_median_codes", f"""with m as (select list(round(q, 6) order by i) as m from (select i, quantile_cont(x, 0.5) as q from ({_COMPONENTS}) where i < 32 group by i))
select vec_id as id, {_signed("list_transform(list_zip(embedding[:32], m), lambda z: z[1]::double - z[2] >= 0)")} as code from embeddings, m""")
def lsh_median_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return SignBits(32, medians=True, digits=6).fit(b).encode(b).select("id", "code")


_HAMMING = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: case when (z[1] >= 0) <> (z[2] >= 0) then 1 else 0 end))::int"


def bits(of: DataFrame) -> DataFrame:
    return of.withColumn("vec", V.pack_words(V.bits_of(F.col("vec")), 64))


def _register_binary(name: str, text: str, run) -> None:
    @query(name, text)
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bits(base(spark, sf_dir)).select("id", "vec", "label")
        return run(b)


_HPAIRS = sql.cross(_HAMMING)
_register_binary("binary_knn", sql.top(_HPAIRS, 5), lambda b: B.knn(asked(b), b, 5))
_register_binary("knn_lsh", sql.top(_HPAIRS, 10), lambda b: B.knn(asked(b), b, 10))
_register_binary("binary_range", f"select * from ({_HPAIRS}) where dis < 24", lambda b: B.range_join(asked(b), b, 24))
_register_binary("hamming_count_pairs", f"select count(*) as n from ({_HPAIRS}) where dis <= 22", lambda b: B.count_pairs(asked(b), b, 22))
_register_binary("hamming_self_pairs", f"select count(*) as n from ({sql.cross(_HAMMING, 'q.vec_id < e.vec_id', 'true')}) where dis <= 20", lambda b: B.count_own_pairs(b, 20))
_register_binary("hamming_histogram", f"select dis, count(*) as n from ({_HPAIRS}) group by dis", lambda b: S.all_pairs(asked(b), b, "hamming").groupBy("dis").agg(F.count("*").alias("n")))
_register_binary("real_to_binary", "select vec_id as id, list_transform(embedding, lambda v: case when v >= 0 then 1.0::double else -1.0::double end) as vec from embeddings", lambda b: b.select("id", V.signs_of(V.unpack_words(F.col("vec"), 64)).alias("vec")))

_KEY = "list_sum(list_transform({v}.embedding[{a}:{b}], lambda x, i: case when x >= 0 then (1 << (i - 1)::int) else 0 end))::bigint"


def _near(a: int, b: int) -> str:
    return f"list_sum(list_transform(list_zip(q.embedding[{a}:{b}], e.embedding[{a}:{b}]), lambda z: case when (z[1] >= 0) <> (z[2] >= 0) then 1 else 0 end)) <= 1"


_register_binary("binary_hash", sql.top(sql.cross(_HAMMING, _near(1, 8)), 3), lambda b: B.hash_knn(asked(b), b, 3, 8, 1))
_register_binary("binary_hash_range", f"select * from ({sql.cross(_HAMMING, _near(1, 8))}) where dis < 26", lambda b: B.hash_range(asked(b), b, 26, 8, 1))
_register_binary("binary_multihash", sql.top(sql.cross(_HAMMING, f"({_near(1, 8)} or {_near(9, 16)})"), 3), lambda b: B.hash_knn(asked(b), b, 3, 8, 1, 2))


@query("generalized_hamming", sql.cross("list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: case when floor(z[1]::double * 4) <> floor(z[2]::double * 4) then 1 else 0 end))::int"))
def generalized_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.floor(x.cast("double") * 4).cast("int")))
    return S.all_pairs(asked(b), b, "hamming_bytes")


@query("pack_bits", """select vec_id as id, (list_sum(list_transform(embedding[:12], lambda v, i: (floor(abs(v::double) * 15) % 16)::bigint << ((i - 1) * 4)::int)))::bigint as packed,
 list_transform(embedding[:12], lambda v: (floor(abs(v::double) * 15) % 16)::int) as codes from embeddings""")
def pack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.transform(F.slice("vec", 1, 12), lambda x: (F.floor(F.abs(x.cast("double")) * 15) % 16).cast("int"))
    packed = base(spark, sf_dir).select("id", V.pack_codes(codes, [4] * 12).alias("packed"))
    return packed.select("id", "packed", V.unpack_codes(F.col("packed"), [4] * 12).alias("codes"))


@query("bit_shuffle", "select vec_id as id, list_transform(range(64), lambda i: (embedding[(i * 5) % 64 + 1] >= 0)::int) as bits from embeddings")
def bit_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("id", V.shuffle_bits(V.bits_of(F.col("vec")), [i * 5 % 64 for i in range(64)]).alias("bits"))


@query("binary_ivf", f"""with c as (select vec_id as list_no, embedding as c from embeddings where vec_id < 8),
h as (select e.vec_id as id, e.embedding as v, list_no, {_HAMMING.replace('e.embedding', 'c.c').replace('q.embedding', 'e.embedding')} as d from embeddings e, c),
own as (select id, v, list_no from h qualify row_number() over (partition by id order by d, list_no) = 1),
p as (select id as qid, v as qv, list_no from h where id % 20 = 0 qualify row_number() over (partition by id order by d, list_no) <= 3)
{sql.top("select qid, own.id, " + _HAMMING.replace('q.embedding', 'qv').replace('e.embedding', 'own.v') + " as dis from p join own using (list_no)", 5)}""")
def binary_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bits(base(spark, sf_dir)).select("id", "vec")
    centroids = b.where("id < 8").select(F.col("id").cast("int").alias("list_no"), F.col("vec").alias("centroid"))
    return B.ivf_knn(asked(b), B.assign(b, centroids), centroids, 5, 3)


# ---- rabitq and spectral bits, centre: mean of all rounded to 6

_RES = sql.zipped("embedding", "m", "{x} - {y}")


_RABITQ = f"""with m as materialized (select {_MEAN} as m), r as (select vec_id as id, embedding, {_RES} as r from embeddings, m),
f as (select id, embedding, r, {sql.fold("list_transform(r, lambda v: v * v)")} as or_c, {sql.fold("list_transform(r, lambda v: abs(v))")} as dp from r)
select id, list_transform(r, lambda v: (v > 0)::int) as bits, or_c, or_c - {sql.norm2('embedding')} as ip_oc, case when or_c = 0 then 0.0 else sqrt(or_c) / (dp / sqrt(or_c) / sqrt(64.0::double)) end as multiplier from f"""


def _center(b: DataFrame):
    return F.array(*[F.lit(x) for x in P.Center(digits=6).fit(b).mean])


@query("rabitq_encode", _RABITQ)
def rabitq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    return rabitq.encode(b, _center(b)).select("id", "bits", "or_c", "ip_oc", "multiplier")


@query("knn_rabitq", f"""with c as ({_RABITQ}), m as materialized (select {_MEAN} as m), q as (select vec_id as qid, {_RES} as r from embeddings, m where vec_id % 20 = 0),
p as (select qid, id, or_c + {sql.fold("list_transform(q.r, lambda v: v * v)")} - 2.0::double * multiplier * ({sql.fold(sql.zipped('c.bits', 'q.r', '(({x} + 0.5 - 1) * 2) * {y}'))} / sqrt(64.0::double)) as dis from q, c)
{sql.top('select qid, id, round(dis, 6) + 0.0 as dis from p', 5)}""")
def knn_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    center = _center(b)
    q = asked(b).select("qid", V.subtract(F.col("qvec"), center).alias("r"))
    return rabitq.knn(q, rabitq.encode(b, center), 5, digits=6)


@query("spectral_bits", f"with m as materialized (select {_MEAN} as m) select vec_id as id, list_transform({_RES}, lambda v: (floor(v * (2.0 / 0.5))::bigint & 1)::int) as bits from embeddings, m")
def spectral_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return b.select("id", SpectralBits(0.5).bits(F.col("vec"), _center(b)).alias("bits"))


# ---- clustering: initial centroids are the first k vectors, rounded to 6 decimals after each update


def _near(rows: str, cent: str, f=sql.l2, descending: bool = False) -> str:
    order = f"{f('embedding', 'c')}{' desc' if descending else ''}, list_no"
    return f"select id, embedding, list_no from (select {rows}, list_no, row_number() over (partition by vec_id order by {order}) as r from embeddings, {cent}) where r = 1"


def _kmeans_sql(k: int, rounds: int, weight: str = "1", spherical: bool = False) -> str:
    text = f"with recursive c0 as (select vec_id::int as list_no, list_transform(embedding, lambda v: round(v::double, 6)) as c from embeddings where vec_id < {k})"
    for i in range(rounds):
        mean = f"sum({weight} * x) / sum({weight})"
        value = f"round({mean}, 6)"
        text += f""", a{i} as materialized ({_near('vec_id as id, embedding', f'c{i}')}),
m{i} as materialized (select list_no, j, {mean if spherical else value} as m from (select id, list_no, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as j from a{i}) group by all),
"""
        if spherical:
            text += f"n{i} as (select list_no, sqrt(sum(m * m)) as n from m{i} group by list_no), c{i + 1} as materialized (select list_no, list(round(m / n, 6) order by j) as c from m{i} join n{i} using (list_no) group by list_no)"
        else:
            text += f"c{i + 1} as materialized (select list_no, list(m order by j) as c from m{i} group by list_no)"
    return text


def _first(b: DataFrame, k: int) -> np.ndarray:
    rows = b.where(F.col("id") < k).orderBy("id").select(F.transform(D.as_double(F.col("vec")), lambda x: F.round(x, 6)).alias("v")).collect()
    return np.array([r["v"] for r in rows])


def _unsigned_zeros(table: DataFrame) -> DataFrame:
    return table.withColumn("centroid", F.transform("centroid", lambda x: x + F.lit(0.0)))


_CENTROID = "list_transform(c, lambda x: x + 0.0)"


@query("kmeans_steps", f"{_kmeans_sql(8, 4)} select list_no, {_CENTROID} as centroid from c4")
def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return _unsigned_zeros(C.KMeans(8, 4, start=_first(b, 8), digits=6).fit(b).table(b))


@query("kmeans_weighted", f"{_kmeans_sql(8, 2, '(1 + id % 3)')} select list_no, {_CENTROID} as centroid from c2")
def kmeans_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).withColumn("w", 1 + F.col("id") % 3)
    return _unsigned_zeros(C.KMeans(8, 2, start=_first(b, 8), digits=6).fit(b, weight="w").table(b))


@query("kmeans_spherical", f"{_kmeans_sql(8, 2, spherical=True)} select list_no, {_CENTROID} as centroid from c2")
def kmeans_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return _unsigned_zeros(C.KMeans(8, 2, start=_first(b, 8), digits=6, spherical=True).fit(b).table(b))


@query("kmeans_assign", f"{_kmeans_sql(8, 2)} select id, list_no from ({_near('vec_id as id, embedding', 'c2')})")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return C.KMeans(8, 2, start=_first(b, 8), digits=6).fit(b).assign(b).select("id", "list_no")


@query("kmeans_random")
def kmeans_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective by iteration for each initialisation."""
    b = base(spark, sf_dir)
    rows = []
    for init in ("random", "k-means++", "afk-mc2"):
        model = C.KMeans(10, 6, init=init).fit(b)
        rows += [(init, i, round(o, 4), round(f, 4), s) for i, (o, f, s) in enumerate(model.stats)]
    return spark.createDataFrame(rows, "init string, iteration int, objective double, imbalance double, splits int")


@query("kmeans1d_exact")
def kmeans1d_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = base(spark, sf_dir).select(F.round(F.col("vec")[0].cast("double"), 3).alias("x"))
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(C.fit_1d(values, "x", 6))], "k int, centroid double")


@query("kmeans_two_level")
def kmeans_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return C.assign_to(b, C.fit_two_level(b, 16, 4)).groupBy("list_no").agg(F.count("*").alias("n"))


@query("kmeans_progressive")
def kmeans_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return C.fit_progressive(b, 8, 4, 4).assign(b).groupBy("list_no").agg(F.count("*").alias("n"))


# ---- inverted files: centroids are per-label means rounded to 6 decimals

_LISTS = """c as (select label as list_no, list(m order by j) as c from (select label, j, round(avg(x), 6) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as j from embeddings) group by all) group by label)"""


def _ivf_sql(tail: str, nprobe: int = 2, f=sql.l2, more: str = "") -> str:
    down = " desc" if f is sql.ip else ""
    return f"""with {_LISTS}, own as materialized (select vec_id as id, embedding as vec, list_no from embeddings, c qualify row_number() over (partition by vec_id order by {f('embedding', 'c')}{down}, list_no) = 1),
p as materialized (select vec_id as qid, embedding as qvec, list_no, c, {f('embedding', 'c')} as coarse, row_number() over (partition by vec_id order by {f('embedding', 'c')}{down}, list_no) as probe from embeddings, c where vec_id % 20 = 0 qualify probe <= {nprobe}){more}
{tail}"""


def index(b: DataFrame, residual: bool = False, which: str = "l2") -> I.Inverted:
    rows = b.select("label", F.posexplode(D.as_double(F.col("vec"))).alias("j", "x")).groupBy("label", "j").agg(F.round(F.avg("x"), 6).alias("m"))
    means = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("c")).orderBy("label").collect()
    return I.Inverted.build(b.select("id", "vec"), np.array([r["c"] for r in means]), which, residual)


_JOIN = f"select qid, own.id, list_no, {sql.l2('qvec', 'vec')} as dis from p join own using (list_no)"


@query("ivf_flat_search", _ivf_sql(sql.top(_JOIN, 5, extra=", list_no")))
def ivf_flat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b).search(asked(b), 5, 2)


@query("ivf_inner_product", _ivf_sql(sql.top(f"select qid, own.id, list_no, {sql.ip('qvec', 'vec')} as dis from p join own using (list_no)", 5, descending=True, extra=", list_no"), f=sql.ip))
def ivf_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b, which="ip").search(asked(b), 5, 2)


@query("ivf_range", _ivf_sql(f"select * from ({_JOIN}) where dis < 1.6"))
def ivf_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b).range_search(asked(b), 1.6, 2)


@query("ivf_selector", _ivf_sql(sql.top(f"select * from ({_JOIN}) where id >= 100 and id < 400", 5, extra=", list_no")))
def ivf_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrill.operators.selectors import IdRange

    b = base(spark, sf_dir)
    return index(b).search(asked(b), 5, 2, selector=IdRange(100, 400))


@query("ivf_max_codes", _ivf_sql(sql.top(_JOIN.replace("from p", "from (select * from t where coalesce(seen, 0) < 80) p"), 5, extra=", list_no"), 4,
       more=", s as (select list_no, count(*) as n from own group by list_no), t as (select p.*, sum(coalesce(n, 0)) over (partition by qid order by probe rows between unbounded preceding and 1 preceding) as seen from p left join s using (list_no))"))
def ivf_max_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b).search(asked(b), 5, 4, most_rows=80)


@query("ivf_preassigned", _ivf_sql(sql.top("select qid, own.id, list_no, " + sql.l2("qvec", "vec") + " as dis from w join own using (list_no)", 5, extra=", list_no"),
       more=f", w as materialized (select vec_id as qid, embedding as qvec, list_no from embeddings, c where vec_id % 20 = 0 qualify row_number() over (partition by vec_id order by {sql.ip('embedding', 'c')} desc, list_no) <= 3)"))
def ivf_preassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller chooses the lists: here those of the largest inner products, for a search by distance."""
    b = base(spark, sf_dir)
    ivf = index(b)
    probes = I.probe(asked(b), ivf.centroids, 3, "ip")
    return top_k(ivf.scan(probes), 5).select("qid", "rank", "id", "dis", "list_no")


@query("ivf_residual", _ivf_sql(sql.top(f"select qid, own.id, list_no, {sql.l2(sql.zipped('qvec', 'c', '{x} - {y}'), sql.zipped('vec', 'c', '{x} - {y}'))} as dis from p join own using (list_no)", 5, extra=", list_no")))
def ivf_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b, residual=True).search(asked(b), 5, 2)


@query("residual_of_centroid", _ivf_sql(f"select id, list_no, {sql.zipped('vec', 'c', '{x} - {y}')} as vec from own join c using (list_no)"))
def residual_of_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(base(spark, sf_dir), residual=True).lists.select("id", "list_no", "vec")


@query("ivf_centroids_of_results", _ivf_sql("select r.*, q.list_no as query_list from (" + sql.top(_JOIN, 3, extra=", list_no") + ") r join (select * from p where probe = 1) q using (qid)"))
def ivf_centroids_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    ivf = index(b)
    own = ivf.probe(asked(b), 1).select("qid", F.col("list_no").alias("query_list"))
    return ivf.search(asked(b), 3, 2).join(own, "qid")


@query("ivf_big_batch", _ivf_sql(sql.top(_JOIN, 5)).replace("id, dis from", "id, round(dis, 6) + 0.0 as dis from", 1))
def ivf_big_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b).search_big(asked(b), 5, 2).withColumn("dis", F.round("dis", 6) + F.lit(0.0))


@query("ivf_statistics", _ivf_sql("select count(distinct qid) as nq, (select count(*) from p) as nlist, count(*) as ndis from p join own using (list_no)"))
def ivf_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    ivf = index(b)
    probes = ivf.probe(asked(b), 2)
    return ivf.scan(probes).agg(F.count_distinct("qid").alias("nq"), F.count("*").alias("ndis")).crossJoin(probes.agg(F.count("*").alias("nlist")))


@query("reconstruct_join", "select vec_id as id, embedding as vec from embeddings where vec_id % 20 = 0")
def reconstruct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return index(b).reconstruct(b.where("id % 20 = 0")).select("id", "vec")


@query("ivf_sq8", _ivf_sql(sql.top(f"select qid, s.id, list_no, {sql.l2('qvec', 's.v')} as dis from p join (select id, list_no, list_transform(vec, lambda x: -1.0::double + (floor(least(greatest((x::double - -1.0) / 2.0, 0.0), 1.0) * 255)::int::double + 0.5) / 255 * 2.0) as v from own) s using (list_no)", 5, extra=", list_no")))
def ivf_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    ivf = index(b)
    sq = ScalarQuantizer(8, uniform=True, low=[-1.0], width=[2.0])
    ivf.lists = sq.decode(sq.encode(ivf.lists)).drop("code")
    return ivf.search(asked(b), 5, 2)


_DOUBLED = "(select vec_id, embedding from embeddings union all select vec_id + 10000, embedding from embeddings where vec_id % 5 = 0)"


@query("ivf_dedup", sql.top(f"select q.vec_id as qid, e.vec_id as id, {sql.l2(Q, E)} as dis from embeddings q, {_DOUBLED} e where q.vec_id % 20 = 0", 6))
def ivf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    distinct, instances = I.deduplicate(b.union(b.where("id % 5 = 0").withColumn("id", F.col("id") + 10000)))
    return I.expand_instances(S.knn(asked(b), distinct, 6), instances, 6)


@query("ivf_duplicates", "select label as list_no, [vec_id, vec_id + 10000] as ids from embeddings where vec_id % 5 = 0")
def ivf_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", F.col("label").alias("list_no"), F.col("vec").alias("code"))
    return I.duplicate_groups(b.union(b.where("id % 5 = 0").withColumn("id", F.col("id") + 10000)))


@query("refine_flat", f"with f as ({sql.top(_HPAIRS, 20)}) {sql.top('select f.qid, f.id, ' + sql.l2(Q, E) + ' as dis from f join embeddings q on q.vec_id = f.qid join embeddings e on e.vec_id = f.id', 5)}")
def refine_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    coded = bits(b)
    return I.refine(B.knn(asked(coded), coded, 20), asked(b), b, 5)


@query("refine_range", f"select f.qid, f.id, {sql.l2(Q, E)} as dis from (select * from ({_HPAIRS}) where dis < 22) f join embeddings q on q.vec_id = f.qid join embeddings e on e.vec_id = f.id")
def refine_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    coded = bits(b)
    return I.refine_range(B.range_join(asked(coded), coded, 22), asked(b), b)


@query("flat_1d", """select qid, rank::int as rank, id, dis from (select q.vec_id as qid, e.vec_id as id, abs(e.embedding[1]::double - q.embedding[1]::double) as dis,
 row_number() over (partition by q.vec_id order by abs(e.embedding[1]::double - q.embedding[1]::double), (e.embedding[1]::double < q.embedding[1]::double)::int, e.vec_id) as rank from embeddings q, embeddings e where q.vec_id % 20 = 0) where rank <= 4""")
def flat_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", F.col("vec")[0].cast("double").alias("x"))
    return I.knn_1d(b.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("x").alias("q")), b, 4)


# ---- codebooks: the first 2**bits vectors' parts


def _books(b: DataFrame, m: int, n: int) -> list[np.ndarray]:
    rows = np.array([r["vec"] for r in b.where(F.col("id") < n).orderBy("id").select(D.as_double(F.col("vec")).alias("vec")).collect()])
    return np.split(rows, m, axis=1)


def _pq_codes(m: int, n: int, w: int) -> str:
    part = [f"embedding[{i * w + 1}:{(i + 1) * w}]" for i in range(m)]
    best = [f"(select arg_min(j, d) from (select k.vec_id::int as j, {sql.l2('e.' + p, 'k.' + p)} as d from embeddings k where k.vec_id < {n} order by d, j limit 1))" for p in part]
    return f"select e.vec_id as id, [{', '.join(best)}] as code from embeddings e"


@query("pq_encode", _pq_codes(4, 16, 16))
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    pq = ProductQuantizer(4, 4, _books(b, 4, 16))
    return b.select("id", pq.code(F.col("vec")).alias("code"))


def _adc(f) -> str:
    terms = " + ".join(f"(select {f(f'q.embedding[{i * 16 + 1}:{(i + 1) * 16}]', f'k.embedding[{i * 16 + 1}:{(i + 1) * 16}]')} from embeddings k where k.vec_id = code[{i + 1}])" for i in range(4))
    return f"with c as materialized ({_pq_codes(4, 16, 16)}) {sql.top(f'select q.vec_id as qid, c.id, 0.0::double + {terms} as dis from embeddings q, c where q.vec_id % 20 = 0', 5, descending=f is sql.ip)}"


def _register_adc(name: str, product: bool) -> None:
    @query(name, _adc(sql.ip if product else sql.l2))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = base(spark, sf_dir)
        pq = ProductQuantizer(4, 4, _books(b, 4, 16))
        coded = b.select("id", pq.code(F.col("vec")).alias("code"))
        tables = asked(b).select("qid", F.array(*[pq.table(F.col("qvec"), i, product) for i in range(4)]).alias("tables"))
        return top_k(coded.crossJoin(F.broadcast(tables)).select("qid", "id", pq.distances(F.col("tables"), F.col("code")).alias("dis")), 5, descending=product).select("qid", "rank", "id", "dis")


_register_adc("pq_adc_knn", False)
_register_adc("pq_adc_ip", True)


@query("pq_sdc_knn", "with c as materialized (" + _pq_codes(4, 16, 16) + ") " + sql.top("select q.id as qid, c.id, 0.0::double + " + " + ".join(
    f"(select {sql.l2(f'a.embedding[{i * 16 + 1}:{(i + 1) * 16}]', f'k.embedding[{i * 16 + 1}:{(i + 1) * 16}]')} from embeddings a, embeddings k where a.vec_id = q.code[{i + 1}] and k.vec_id = c.code[{i + 1}])" for i in range(4)) + " as dis from c q, c where q.id % 20 = 0", 5))
def pq_sdc_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    pq = ProductQuantizer(4, 4, _books(b, 4, 16))
    coded = b.select("id", pq.code(F.col("vec")).alias("code"))
    q = coded.where("id % 20 = 0").select(F.col("id").alias("qid"), pq.value(F.col("code")).alias("qvec"))
    tables = q.select("qid", F.array(*[pq.table(F.col("qvec"), i) for i in range(4)]).alias("tables"))
    return top_k(coded.crossJoin(F.broadcast(tables)).select("qid", "id", pq.distances(F.col("tables"), F.col("code")).alias("dis")), 5).select("qid", "rank", "id", "dis")


_CODE_HAMMING = "list_sum(list_transform(list_zip(q.code, c.code), lambda z: bit_count(xor(z[1], z[2]))))::int"


@query("pq_polysemous_filter", "with c as materialized (" + _pq_codes(4, 16, 16) + f") select q.id as qid, c.id, {_CODE_HAMMING} as dis from c q, c where q.id % 20 = 0 and {_CODE_HAMMING} < 5")
def pq_polysemous_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose codes differ in fewer bits than a threshold: the filter ahead of the dearer distance."""
    b = base(spark, sf_dir)
    pq = ProductQuantizer(4, 4, _books(b, 4, 16))
    coded = b.select("id", pq.code(F.col("vec")).alias("code"))
    q = coded.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("code").alias("qcode"))
    apart = F.aggregate(F.zip_with("qcode", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return coded.crossJoin(F.broadcast(q)).select("qid", "id", apart.alias("dis")).where("dis < 5")


_IMI = " , ".join(f"t{s} as (select q.vec_id as qid, k.vec_id as j, {sql.l2(f'q.embedding[{s * 32 + 1}:{s * 32 + 32}]', f'k.embedding[{s * 32 + 1}:{s * 32 + 32}]')} as d from embeddings q, embeddings k where q.vec_id % 20 = 0 and k.vec_id < 8)" for s in range(2))


@query("imi_assign", f"with {_IMI} select qid, rank::int as probe, list_no, dis from (select qid, (t0.j | (t1.j << 3))::bigint as list_no, 0.0::double + t0.d + t1.d as dis, row_number() over (partition by qid order by 0.0::double + t0.d + t1.d, (t0.j | (t1.j << 3))) as rank from t0 join t1 using (qid)) where rank <= 6")
def imi_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return I.multi_index_probe(asked(b), _books(b, 2, 8), 6)


@query("split_vectors_k1", f"with {_IMI}, b0 as (select qid, min(j) as j, min(d) as d from (select *, min(d) over (partition by qid) as m from t0) where d = m group by qid), b1 as (select qid, min(j) as j, min(d) as d from (select *, min(d) over (partition by qid) as m from t1) where d = m group by qid) select qid, (b0.j + b1.j * 8)::bigint as id, 0.0::double + b0.d + b1.d as dis from b0 join b1 using (qid)")
def split_vectors_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).where("id < 8")
    parts = [b.select("id", F.slice("vec", s * 32 + 1, 32).alias("vec")) for s in range(2)]
    return I.split_nearest(asked(base(spark, sf_dir)), parts, [32, 32])


@query("rq_encode_beam1", f"""with c0 as (select vec_id::int as j, embedding as c from embeddings where vec_id < 8), c1 as (select (vec_id - 8)::int as j, list_transform(embedding, lambda v: v::double * 0.5) as c from embeddings where vec_id >= 8 and vec_id < 16),
s0 as materialized (select vec_id as id, embedding, j as j0, c as v0 from embeddings, c0 qualify row_number() over (partition by vec_id order by {sql.l2('embedding', 'c')}, j) = 1),
r0 as materialized (select id, j0, {sql.zipped('embedding', 'v0', '{x} - {y}')} as r from s0)
select id, [j0, j] as code from r0, c1 qualify row_number() over (partition by id order by {sql.l2('r', 'c')}, j) = 1""")
def rq_encode_beam1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("id", "vec")
    rows = _books(b, 1, 16)[0]
    rq = ResidualQuantizer(2, 3, beam=1, books=[rows[:8], rows[8:] * 0.5])
    return rq.encode(b).select("id", "code")


@query("two_layer_codec", _ivf_sql(f"""select id, list_no, list_transform({sql.zipped('vec', 'c', '{x} - {y}')}, lambda v: floor(least(greatest((v - -1.0) / 2.0, 0.0), 1.0) * 255)::int) as code from own join c using (list_no)"""))
def two_layer_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse number and the code of the residual."""
    lists = index(base(spark, sf_dir), residual=True).lists
    return ScalarQuantizer(8, uniform=True, low=[-1.0], width=[2.0]).encode(lists).select("id", "list_no", "code")


@query("sparse_assign", f"select id, list_no from ({_near('vec_id as id, embedding', '(select vec_id::int as list_no, embedding as c from embeddings where vec_id < 8)').replace('from embeddings, ', 'from (select vec_id, list_transform(embedding, lambda v: case when abs(v) < 0.1 then 0.0 else v end) as embedding from embeddings), ')})")
def sparse_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of dense centroids to sparse rows (id, i, x), from norms and products of the entries present."""
    b = base(spark, sf_dir)
    centroids = b.where("id < 8").select(F.col("id").cast("int").alias("list_no"), F.posexplode(D.as_double(F.col("vec"))).alias("i", "c"))
    norms = centroids.groupBy("list_no").agg(F.sum(F.col("c") * F.col("c")).alias("n2"))
    rows = b.select("id", F.posexplode(D.as_double(F.col("vec"))).alias("i", "x")).where("abs(x) >= 0.1f")
    dots = rows.join(F.broadcast(centroids), "i").groupBy("id", "list_no").agg(F.sum(F.col("x") * F.col("c")).alias("dot"))
    return dots.join(F.broadcast(norms), "list_no").groupBy("id").agg(F.min(F.struct((F.col("n2") - 2 * F.col("dot")).alias("d"), "list_no")).alias("b")).select("id", F.col("b.list_no").alias("list_no"))
