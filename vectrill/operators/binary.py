"""Binary vectors: arrays of 64-bit words under Hamming distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.functions import distances as D
from vectrill.functions.vectors import pack_words, signs_of, unpack_words
from vectrill.operators import search
from vectrill.operators.topk import top_k


def knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    return search.knn(queries, base, k, "hamming")


def range_join(queries: DataFrame, base: DataFrame, radius: int) -> DataFrame:
    pairs = search.all_pairs(queries, base, "hamming")
    return pairs.where(F.col("dis") < radius)


def count_pairs(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(n): pairs at a distance of ``most`` or less."""
    return search.all_pairs(left, right, "hamming").where(F.col("dis") <= most).agg(F.count("*").alias("n"))


def count_own_pairs(base: DataFrame, most: int) -> DataFrame:
    """(n): unordered pairs of different rows of one table."""
    other = base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return search.all_pairs(other, base, "hamming").where((F.col("dis") <= most) & (F.col("qid") < F.col("id"))).agg(F.count("*").alias("n"))


def hash_key(words: Column, start: int, bits: int) -> Column:
    """Bits start to start + bits of the code, within one word."""
    if start // 64 != (start + bits - 1) // 64:
        raise ValueError("a key may not cross 64-bit words")
    return F.shiftrightunsigned(words[start // 64], start % 64).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _flips(bits: int, flips: int) -> list[int]:
    return [sum(1 << b for b in at) for n in range(flips + 1) for at in combinations(range(bits), n)]


def hash_candidates(queries: DataFrame, base: DataFrame, bits: int, flips: int = 0, tables: int = 1) -> DataFrame:
    """(qid, id): rows whose key differs from the query's by at most ``flips`` bits in one of the hash tables."""
    masks = F.array(*[F.lit(m).cast("long") for m in _flips(bits, flips)])
    found = None
    for t in range(tables):
        q = queries.select("qid", F.explode(F.transform(masks, lambda m: hash_key(F.col("qvec"), t * bits, bits).bitwiseXOR(m))).alias("key"))  # noqa: B023
        rows = base.select("id", hash_key(F.col("vec"), t * bits, bits).alias("key"))
        hits = q.join(rows, "key").select("qid", "id")
        found = hits if found is None else found.union(hits)
    return found.distinct() if tables > 1 else found


def hash_knn(queries: DataFrame, base: DataFrame, k: int, bits: int, flips: int = 0, tables: int = 1) -> DataFrame:
    candidates = hash_candidates(queries, base, bits, flips, tables)
    return search.knn_among(candidates, queries, base, k, "hamming")


def hash_range(queries: DataFrame, base: DataFrame, radius: int, bits: int, flips: int = 0, tables: int = 1) -> DataFrame:
    candidates = hash_candidates(queries, base, bits, flips, tables)
    return search.distances_to(candidates, queries, base, "hamming").where(F.col("dis") < radius)


def assign(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """``base`` with the list_no of the nearest binary centroid (list_no, centroid)."""
    pairs = base.crossJoin(F.broadcast(centroids)).withColumn("_d", D.hamming(F.col("vec"), F.col("centroid")))
    best = pairs.groupBy("id").agg(F.min(F.struct("_d", "list_no")).alias("b"))
    return base.join(best.select("id", F.col("b.list_no").alias("list_no")), "id")


def ivf_knn(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """k-NN in the lists of the ``nprobe`` nearest binary centroids."""
    pairs = queries.crossJoin(F.broadcast(centroids)).withColumn("_c", D.hamming(F.col("qvec"), F.col("centroid")))
    probes = top_k(pairs, nprobe, by="_c", tie="list_no").drop("rank", "_c")
    found = probes.join(lists, "list_no").select("qid", "id", D.hamming(F.col("qvec"), F.col("vec")).alias("dis"))
    return top_k(found, k).select("qid", "rank", "id", "dis")


def train_centroids(base: DataFrame, n_bits: int, k: int, rounds: int = 10) -> DataFrame:
    """Binary centroids: k-means of the codes as +1 and -1, back to bits where a component is over 0."""
    from vectrill.operators.clustering import KMeans

    signs = base.withColumn("vec", signs_of(unpack_words(F.col("vec"), n_bits)))
    model = KMeans(k, rounds).fit(signs)
    table = model.table(base)
    return table.withColumn("centroid", pack_words(F.transform("centroid", lambda x: (x > 0).cast("int")), n_bits))
