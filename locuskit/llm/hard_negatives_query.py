"""op12: hard negatives of every hundredth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.common import read_table
from locuskit.llm.hard_negatives import hard_negatives
from locuskit.llm.registry import query

SQL = """
with c as (select row_number() over () as r, vec_id,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as materialized (select a.r as a, a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id,
    list_inner_product(a.q, b.q)::bigint as score
  from c a join c b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select a, id as positive_id, score as positive_score, n from (
    select *, row_number() over (partition by a order by score desc, id) as n from s where same) where n <= 5)
select anchor_id, positive_id, rank::int as rank, id as negative_id, positive_score, score as negative_score
from (select *, row_number() over (partition by a, n order by score desc, id) as rank
  from p join s using (a) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
where rank <= 10
"""


@query("op12_zone_maps", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", flipped.alias("label")), F.col("vec_id") % 100 == 0)
