"""One thin query per operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.llm import decontamination, html_text, jaccard_join, line_crf, lm_scoring, mixing, pii, quality_rules, sharding, token_tree
from vectrill.llm.registry import query
from vectrill.runtime import table

MIX_SQL = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5.0, 2.0, 1.0]::double[])[1 + ((row_number() over (order by source asc nulls last) - 1) % 3)::int] as weight,
  source_size * 2.0::double as most from s),
l as (select *, (sum(source_size) over () * 1.5::double
    - coalesce(sum(most) over (order by most / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source asc nulls last rows between current row and unbounded following) as level from w),
f as (select *, max(case when level * weight < most then level end) over () as last from l),
t as (select source, source_size, case when level * weight >= most or last is null then most else last * weight end as target,
  ('0x' || substr(md5(case when source is null then 'mix?' else 'mix=' || source end), 1, 8))::bigint::double / 4294967296.0::double as u from f),
r as (select d.*, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0 end as each,
  (row_number() over (partition by d.source order by size, doc_id nulls first) - 1)::double as rank
  from d join t on d.source is not distinct from t.source),
k as (select k, k / 16.0::double as moved from (select unnest(range(16)) as k)),
c as (select *, (size * (floor((rank + 1) * each + v) - floor(rank * each + v)))::bigint as taken
  from (select r.*, k.k, (u + moved) - floor(u + moved) as v from r, k)),
g as (select source, k, row_number() over (partition by source order by abs(sum(taken) - target), k) as best from c group by source, k, target)
select doc_id, size, source_size, target, taken from c join g on c.k = g.k and c.source is not distinct from g.source and g.best = 1
"""


@query("op4_mix_sources", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _normal_words(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE_SQL = f"""
with b as (select item_id, {_normal_words("text")} as w from benchmark),
bs as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from
  (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
d as (select doc_id, {_normal_words("text")} as w from documents),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as s from
  (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bs) where len(w) >= k)),
h as (select doc_id, k, i, item_id from dw join bs using (k, s)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""


@query("op3_decontaminate", DECONTAMINATE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


@query("op10_shard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(docs)


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rules = quality_rules.learn_from(docs, labels)
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@query("op9_line_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return line_crf.score(docs, line_crf.train_from(docs, labels))


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_extract_html")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train_from(docs))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tree.count_with_edits(table(spark, sf_dir, "documents"))
