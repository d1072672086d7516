"""op4: near-duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.near_dedup import near_duplicates
from locuskit.llm.registry import query

SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[g.generate_series:g.generate_series + least(len(ws), 5) - 1], ' ') as gram
  from d, generate_series(1, len(ws) - least(len(ws), 5) + 1) g where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (gram) where a.doc_id <> b.doc_id
  group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select a as doc_id, a as via from (select distinct a from links) union select doc_id, b from reach join links on a = via),
comp as (select doc_id, min(via) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id,
  coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join comp using (doc_id)
"""


@query("op4_chosen_path", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
