"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Every source gets a target number of words by weight, capped at a multiple of its own size. A document's expected
copies are its source's target over its size. The expected copies are summed up along an order within the source, a
random offset is added, and a document is emitted once for each integer boundary that its interval crosses.

The order is by size, so that neighbours are nearly equal in size and the taken words stay within about one document
of the target, the largest. As that can be much for a small source, the offset is one of ``DRAWS`` that lie evenly
behind a random start: that whose taken words come nearest to the target. The prefix sum is distributed: rows are range-partitioned by (source, size, key), which splits a hot
source over many tasks, each task numbers its rows, and only one count per partition and source is summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrill.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
DRAWS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, a row per source, with ``target``.

    Sources by code point, NULL last, get the weights in turn. Filling up by weight with caps ends where every
    source has min(cap, weight * level); the level follows from the sources sorted by cap / weight. The windows run
    over one row per source, which is metadata and not data.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (k + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = filling.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("most").over(up_to), F.lit(0.0))) / F.sum("weight").over(from_here)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # levels fall behind the first that is not full
    target = F.when(F.col("full") | last.isNull(), F.col("most")).otherwise(last * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def offset(source: Column, seed: str) -> Column:
    """The first of a source's random offsets in [0, 1): 32 bits of a digest of the seed and its name."""
    named = F.when(source.isNull(), F.lit(f"{seed}?")).otherwise(F.concat(F.lit(f"{seed}="), source))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, and ``carry``.

    * NULL texts have size 0; a source of size 0 has target 0 and takes nothing.
    * Repeated rows and equal keys are documents of their own; NULL keys come first in the order.
    * An empty table gives an empty result. Columns that aren't named here aren't read.
    """
    spark = docs.sparkSession
    payload = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), *payload)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ["_source", "_size", "_key"]
    placed = rows.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "mix")

    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part, "_source").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum("_size").alias("_words"))
    counts = materialize(counts.coalesce(1), "mix-counts")  # a row per partition and source in it
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = counts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "_target_source")
    begins = begins.join(targets, F.col("_source").eqNullSafe(F.col("_target_source"))).select(
        "_part", F.col("_source").alias("_s"), "_first", "_begin", "source_size", "target")

    # begins has at most (partitions + sources) rows, as each partition boundary cuts one source.
    begins = F.broadcast(materialize(begins.withColumnRenamed("_part", "_p"), "mix-begins"))
    joined = placed.withColumn("_part", part).join(begins, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    rank = (F.col("_at") - F.col("_first") + F.col("_begin")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def copies(u: Column) -> Column:
        return (F.floor((rank + 1) * each + u) - F.floor(rank * each + u)).cast("long")

    def draw(k: int) -> Column:
        moved = offset(F.col("_source"), seed) + F.lit(k / DRAWS)
        return moved - F.floor(moved)

    totals = joined.groupBy("_source", "target").agg(*[F.sum(F.col("_size") * copies(draw(k))).alias(f"_t{k}") for k in range(DRAWS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), draw(k).alias("u")) for k in range(DRAWS)]))
    # a row per source
    draws = materialize(totals.select(F.col("_source").alias("_drawn"), nearest["u"].alias("_u")).coalesce(1), "mix-draws")
    out = joined.join(F.broadcast(draws), F.col("_source").eqNullSafe(F.col("_drawn"))).withColumn("copies", copies(F.col("_u")))
    return out.select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", "copies",
        (F.col("_size") * F.col("copies")).alias("taken"), *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry) if c not in (key, source)])
