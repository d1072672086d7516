"""op11: forty clusters of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.centroids import cluster, digest
from locuskit.llm.common import read_table
from locuskit.llm.registry import query

K, ROUNDS, DIMS = 40, 5, 64


def sql() -> str:
    """Each round spelled out: all distances, then the floor of every cluster's mean."""
    parts = [f"""with kept as (select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS}),
e as materialized (select r, i.generate_series as d, floor(256 * embedding[i.generate_series]::double)::bigint as v
  from kept, generate_series(1, {DIMS}) i),
first as (select r, row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')),
    list_transform(embedding, lambda x: floor(256 * x::double))) - 1 as c from kept),
c0 as materialized (select c, d, v from first join e using (r) where c < {K})"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} as materialized (select r, min(far) as far, arg_min(c, (far, c)) as c from (
  select r, c, sum((e.v - c{n}.v) * (e.v - c{n}.v))::bigint as far from e join c{n} using (d) group by r, c) group by r)""")
        if n < ROUNDS:
            parts.append(f"""m{n} as (select c, d, sum(v)::bigint as s, count(*) as n from a{n} join e using (r) group by c, d),
c{n + 1} as materialized (select c, d, coalesce((s - ((s % n) + n) % n) // n, c{n}.v) as v from c{n} left join m{n} using (c, d))""")
    return ",\n".join(parts) + f""",
h as (select c, sha256(string_agg(v::varchar, ',' order by d)) as centroid_sha256 from c{ROUNDS} group by c),
t as (select c, sum(far)::bigint as cluster_inertia from a{ROUNDS} group by c)
select vec_id, c::int as cluster, far as distance, cluster_inertia, (select sum(far)::bigint from a{ROUNDS}) as inertia,
  centroid_sha256
from a{ROUNDS} join kept using (r) join h using (c) join t using (c)"""


@query("op11_pca_filter", sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), K, ROUNDS, DIMS)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = spark.createDataFrame([(c, sums[c], sum(sums.values()), digest(centroids[c])) for c in sorted(sums)],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = rows.join(F.broadcast(named), "cluster")  # a row for each of the forty clusters
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
