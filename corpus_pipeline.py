"""From raw documents to shards of a training mix: five stages, each one of the operators in ``vectrill.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's documents. All but the last return the columns of the documents. Added columns carry a prefix while a
stage works, so that columns of those names in the input pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from vectrill.llm.components import sized
from vectrill.llm.names import fresh, quoted, without
from vectrill.runtime import discard, mark, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that a learned rule rejects go."""
    rules = quality_rules.learn_from(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules, prefix="_q_", drop_text=False)
    return judged.where("_q_kept").select(*map(quoted, docs.columns))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents one row stays: that of the smallest id, NULL last.

    Rows are documents of their own, also if they repeat an id or have none. Ids that tell the rows apart serve as the
    rows' names; otherwise the rows are numbered first.
    """
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == distinct:
        groups = materialize(jaccard_join.join_components(docs.select("doc_id", "text")).select("doc_id", "component_id"), "groups")
        gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(sized(materialize(gone, "gone")), F.col("doc_id") == F.col("_gone"), "left_anti")
    (row,) = fresh(docs.columns, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_join.join_components(rows.select(row, "text"), row).select(F.col(row).alias("_gone"), "component_id")
    groups = materialize(groups.join(rows.select(row, "doc_id"), F.col("_gone") == F.col(row)).select("_gone", "component_id", "doc_id"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_gone")
    first = groups.groupBy("component_id").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("component_id", F.col("_first._gone").alias("_stays"))
    gone = groups.join(sized(materialize(first, "first")), "component_id").where("_gone <> _stays").select("_gone")
    return rows.join(sized(materialize(gone, "gone")), F.col(row) == F.col("_gone"), "left_anti").drop(row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix="_d_")
    return found.where("not _d_contaminated").select(*map(quoted, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    names = {c: f"_m_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[quoted(c).alias(n) for c, n in names.items()])
    taken = mixing.mix(renamed, names["doc_id"], names["text"], names["source"], carry=tuple(names.values()))
    repeated = taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, digest, shard and place in it. Input columns of these names are replaced."""
    text = F.coalesce("text", F.lit(""))
    added = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    own = without(docs, (*added, "law", "shard", "slot", "grown_shard"))
    return sharding.shard(docs.select(*map(quoted, own), *[v.alias(c) for c, v in added.items()]))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mix_sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned rules and connected components have no equivalent in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
