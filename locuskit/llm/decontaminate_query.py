"""op9: all documents against all benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuskit.llm.common import read_table
from locuskit.llm.decontaminate import contamination
from locuskit.llm.registry import query

SQL = r"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark where item_id is not null),
item as (select distinct cast(item_id as varchar) as item_id, least(len(ws), 10) as n,
    array_to_string(ws[g.generate_series:g.generate_series + least(len(ws), 10) - 1], ' ') as gram
  from b, generate_series(1, len(ws) - least(len(ws), 10) + 1) g where len(ws) > 0),
lens as (select distinct n from item),
doc as (select r, n, g.generate_series as i, array_to_string(ws[g.generate_series:g.generate_series + n - 1], ' ') as gram
  from d, lens, generate_series(1, len(ws) - n + 1) g where len(ws) >= n),
hit as (select doc.r, doc.n, doc.i, item.item_id from doc join item using (n, gram)),
words as (select r, count(distinct i + o.generate_series) as n_hit from hit, generate_series(0, n - 1) o group by r),
ids as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list
  from (select distinct r, item_id from hit) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (r) left join ids using (r)
"""


@query("op9_winnowing", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                         read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
