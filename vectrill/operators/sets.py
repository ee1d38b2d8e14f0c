"""Set operations, deletes, upserts, subsets and sharding of vector tables and inverted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(base: DataFrame, other: DataFrame, shift: int = 0) -> DataFrame:
    """Append ``other`` with its ids moved by ``shift``."""
    return base.unionByName(other.withColumn("id", F.col("id") + shift))


def remove_compact(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Delete ids and number the rest anew from 0 (``new_id``), in the order of ids.

    Positions are counted per range partition and summed up, so that no task sees all rows.
    """
    left = df.join(removed.select("id"), "id", "left_anti")
    return with_positions(left, "new_id")


def with_positions(df: DataFrame, name: str, order: str = "id") -> DataFrame:
    """Dense positions from 0 in the order of a column, by a distributed prefix sum."""
    from vectrill.runtime import materialize

    placed = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    # a row per partition
    joined = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_begin")).drop("_at", "_part", "_first", "_begin")


def remove_stable(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Delete ids; all others keep theirs."""
    return df.join(removed.select("id"), "id", "left_anti")


def update(df: DataFrame, changed: DataFrame) -> DataFrame:
    """Upsert: rows of ``changed`` take the place of those with their ids."""
    return remove_stable(df, changed).unionByName(changed)


def subset_id_range(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.where((F.col("id") >= low) & (F.col("id") < high))


def subset_id_mod(df: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return df.where(F.pmod("id", F.lit(modulus)) == remainder)


def _within(list_no: str) -> tuple[Column, Column]:
    w = Window.partitionBy(list_no)
    return F.row_number().over(w.orderBy("id")) - 1, F.count("*").over(w)


def subset_list_fraction(lists: DataFrame, parts: int, part: int, list_no: str = "list_no") -> DataFrame:
    """The ``part``-th of ``parts`` pieces of every list, by offset."""
    offset, n = _within(list_no)
    found = lists.withColumn("_o", offset).withColumn("_n", n)
    return found.where((F.col("_o") >= F.floor(F.col("_n") * part / parts)) & (F.col("_o") < F.floor(F.col("_n") * (part + 1) / parts))).drop("_o", "_n")


def subset_elements(lists: DataFrame, low: int, high: int, list_no: str = "list_no") -> DataFrame:
    """Rows low to high of all, dealt over the lists in proportion to the running list sizes."""
    sizes = lists.groupBy(list_no).agg(F.count("*").alias("_n"))
    order = Window.orderBy(list_no)
    total = F.sum("_n").over(Window.partitionBy())
    running = F.sum("_n").over(order)
    edge = lambda r, x: F.floor(r * x / total)
    bounds = sizes.select(list_no, (edge(running, low) - edge(running - F.col("_n"), low)).alias("_a"), (edge(running, high) - edge(running - F.col("_n"), high)).alias("_b"))
    offset, _ = _within(list_no)
    return lists.withColumn("_o", offset).join(F.broadcast(bounds), list_no).where("_o >= _a and _o < _b").drop("_o", "_a", "_b")


def subset_lists(lists: DataFrame, low: int, high: int, list_no: str = "list_no") -> DataFrame:
    return lists.where((F.col(list_no) >= low) & (F.col(list_no) < high))


def hstack(lists: list[DataFrame]) -> DataFrame:
    """Lists of the same number put together."""
    joined = lists[0]
    for x in lists[1:]:
        joined = joined.unionByName(x)
    return joined


def vstack(lists: list[tuple[DataFrame, int]], list_no: str = "list_no") -> DataFrame:
    """List spaces one after the other: (lists, how many they are)."""
    moved, start = [], 0
    for x, n in lists:
        moved.append(x.withColumn(list_no, F.col(list_no) + start))
        start += n
    return hstack(moved)


def masked(first: DataFrame, second: DataFrame, list_no: str = "list_no") -> DataFrame:
    """A list from ``first`` where it has rows, from ``second`` elsewhere."""
    return first.unionByName(second.join(first.select(list_no).distinct(), list_no, "left_anti"))


def without_stop_lists(lists: DataFrame, most: int, list_no: str = "list_no") -> DataFrame:
    """Lists with fewer than ``most`` rows."""
    kept = lists.groupBy(list_no).count().where(F.col("count") < most).select(list_no)
    return lists.join(kept, list_no, "left_semi")


def set_lists(lists: DataFrame, other: DataFrame, low: int, high: int, list_no: str = "list_no") -> DataFrame:
    """Lists low to high taken from ``other`` instead."""
    inside = (F.col(list_no) >= low) & (F.col(list_no) < high)
    return lists.where(~inside).unionByName(other.where(inside))


def shard_of(list_no: Column, shards: int) -> Column:
    """The default sharding function; any expression of the list number can take its place."""
    return F.pmod(list_no, F.lit(shards))


def contiguous_shard(position: Column, n: int, shards: int) -> Column:
    """Shards that split positions 0 to n - 1 into contiguous parts."""
    return F.floor(((position + 1) * shards - 1) / n).cast("int")


def bucket_sort(df: DataFrame, bucket: str, n: int) -> DataFrame:
    """(bucket, begin, n): where each bucket's rows begin in the order by bucket; empty buckets count."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias(bucket)).join(counts, bucket, "left")
    every = every.select(bucket, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return every.withColumn("begin", (F.sum("n").over(Window.orderBy(bucket)) - F.col("n")).cast("long"))


def intersection_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many ids two result tables (qid, id) have in common, by query."""
    # either table is read once: a search in front of it isn't made again
    marked = right.select("qid", "id").distinct().withColumn("_both", F.lit(1))
    return left.select("qid", "id").join(marked, ["qid", "id"], "left").groupBy("qid").agg(F.count("_both").alias("n"))


def lists_by_size(lists: DataFrame, list_no: str = "list_no") -> DataFrame:
    """List numbers given anew, the largest list first (the smaller old number of equals), with ``old_list_no``."""
    sizes = lists.groupBy(list_no).agg(F.count("*").alias("_n"))
    place = (F.row_number().over(Window.orderBy(F.col("_n").desc(), F.col(list_no))) - 1).alias("_new")
    order = sizes.select(F.col(list_no).alias("old_list_no"), place)
    # a row per list
    renamed = lists.withColumnRenamed(list_no, "old_list_no").join(F.broadcast(order), "old_list_no")
    return renamed.withColumnRenamed("_new", list_no)


def reorder(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows renumbered: ``order`` is (id, new_id)."""
    return df.join(order, "id").drop("id").withColumnRenamed("new_id", "id")
